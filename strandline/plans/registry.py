"""A registry of operators and codecs by entry point, behind an allow-list, with health probes and reports."""

from __future__ import annotations

import importlib
import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

_ENTRY = re.compile(r"^strandline(?:\.[a-z_]+)+:[A-Za-z_][A-Za-z0-9_]*$")
_ID = re.compile(r"^[a-z0-9][a-z0-9._-]{0,79}$")


@dataclass(frozen=True)
class Spec:
    """An algorithm: id, entry point module:attribute, what it serves, and where it comes from."""

    id: str
    entry: str
    serves: tuple[str, ...] = ()
    license: str = ""
    source: str = ""
    commit: str = ""
    notes: dict = field(default_factory=dict)


class Registry:
    def __init__(self, gate: re.Pattern = _ENTRY):
        self.gate, self.specs, self.probes = gate, {}, {}

    def _checked(self, spec: Spec) -> Spec:
        if not _ID.match(spec.id):
            raise ValueError(f"{spec.id!r} is no id")
        if not self.gate.match(spec.entry):
            raise ValueError(f"{spec.entry} isn't an allowed entry point")
        if spec.source and not (spec.license and re.fullmatch(r"[0-9a-f]{7,64}", spec.commit)):
            raise ValueError(f"{spec.id}: what comes from elsewhere needs its license and commit")
        return spec

    def register(self, spec: Spec, probe: Callable[[], bool] | None = None, replace: bool = False) -> None:
        if spec.id in self.specs and not replace:
            raise ValueError(f"{spec.id} is there already")
        self.specs[self._checked(spec).id] = spec
        if probe:
            self.probes[spec.id] = probe

    def load(self, manifest: str) -> list[str]:
        """All specs of a JSON manifest, or, if one is wrong, none."""
        made = [self._checked(Spec(**{**s, "serves": tuple(s.get("serves", ()))})) for s in json.loads(manifest)["algorithms"]]
        ids = [s.id for s in made]
        if len(set(ids)) != len(ids) or set(ids) & set(self.specs):
            raise ValueError("ids repeat")
        self.specs.update({s.id: s for s in made})
        return ids

    def resolve(self, name: str) -> Callable:
        if name not in self.specs:
            raise ValueError(f"no algorithm {name}")
        module, _, attribute = self.specs[name].entry.partition(":")
        return getattr(importlib.import_module(module), attribute)

    def health(self) -> dict[str, dict]:
        """For each id whether it resolves and its probe, if any, holds; a probe that raises doesn't."""
        out = {}
        for name in self.specs:
            began = time.perf_counter()
            try:
                ok, error = callable(self.resolve(name)) and bool(self.probes.get(name, lambda: True)()), ""
            except Exception as e:  # a probe may fail in any way, and that is its result
                ok, error = False, f"{type(e).__name__}: {e}"
            out[name] = {"ok": ok, "error": error, "seconds": time.perf_counter() - began}
        return out

    def matrix(self) -> dict[str, list[str]]:
        """Algorithms by what they serve."""
        out: dict[str, list[str]] = {}
        for spec in self.specs.values():
            for s in spec.serves:
                out.setdefault(s, []).append(spec.id)
        return {k: sorted(v) for k, v in sorted(out.items())}


def default_registry() -> Registry:
    made = Registry()
    for name, entry, serves in (
        ("align", "strandline.operators.align:align", ("alignment",)), ("fuse", "strandline.operators.align:fuse", ("fusion",)), ("assess", "strandline.operators.quality:assess", ("quality", "assessment")),
        ("window-quality", "strandline.operators.windows:window_quality", ("quality",)), ("govern", "strandline.operators.govern:govern", ("governance",)), ("schema-match", "strandline.operators.matching:match_schemas", ("normalization",)),
        ("fuzzy-tokens", "strandline.operators.matching:fuzzy_tokens", ("alignment",)), ("compress", "strandline.codecs.frames:compress", ("compression",)), ("range-filter", "strandline.codecs.frames:range_filter", ("compression", "storage")),
        ("reorder", "strandline.codecs.reorder:encode", ("compression",)), ("parse", "strandline.sources.text:parse_payloads", ("parsing", "normalization")), ("ring", "strandline.streaming.ingest:Ring", ("ingestion",)),
        ("store-sequence", "strandline.operators.store:store_sequence", ("storage",)), ("store-relation", "strandline.operators.store:store_relation", ("storage",)),
    ):
        made.register(Spec(name, entry, serves))
    return made


def write_report(report: dict, folder: str, name: str) -> Path:
    """A JSON report under a name of its own, complete or not there; then a marker that it is."""
    path = Path(folder) / f"{name}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_suffix(".part")
    part.write_text(json.dumps(report, ensure_ascii=False, default=str, indent=1), encoding="utf-8")
    part.replace(path)
    path.with_suffix(".completed").touch()
    return path


def prune(folder: str, keep: int, grace_s: float = 0.0, active: frozenset[str] = frozenset()) -> list[str]:
    """Remove all but the newest `keep` completed reports; what isn't complete, is younger than the grace or in use stays."""
    if keep < 0:
        raise ValueError("keep can't be negative")
    done = [p for p in Path(folder).glob("*.json") if p.with_suffix(".completed").exists()]
    done.sort(key=lambda p: (p.stat().st_mtime, p.name), reverse=True)
    gone = []
    for p in done[keep:]:
        if p.stem not in active and time.time() - p.stat().st_mtime >= grace_s:
            p.with_suffix(".completed").unlink(missing_ok=True)
            p.unlink(missing_ok=True)
            gone.append(p.stem)
    return gone
