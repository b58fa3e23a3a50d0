"""Workflows over registered kinds: a lazy DAG of frames with memo, receipts and the weakest warrant."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.mart import LADDER


@dataclass
class Kind:
    """A kind of step: run(spec, inputs) -> DataFrame, and the warrant of what it gives."""

    name: str
    run: Callable[[dict, list[DataFrame]], DataFrame]
    warrant: str = "derived"
    capabilities: tuple[str, ...] = ()


@dataclass
class Engine:
    """Kinds, results kept by specification, and a hash chain of receipts."""

    kinds: dict[str, Kind] = field(default_factory=dict)
    memo: dict[str, DataFrame] = field(default_factory=dict)
    receipts: list[dict] = field(default_factory=list)
    memo_size: int = 2048

    def register(self, kind: Kind) -> None:
        self.kinds[kind.name] = kind

    def find(self, capability: str) -> list[str]:
        """Names of kinds with a capability, in order."""
        return sorted(k.name for k in self.kinds.values() if capability in k.capabilities)

    def order(self, steps: list[dict]) -> list[dict]:
        """Steps after all they come from, ties by name; an unknown name or a cycle is an error."""
        by_name = {s["name"]: s for s in steps}
        if len(by_name) != len(steps):
            raise ValueError("two steps of one name")
        waiting = {s["name"]: set(s.get("from", ())) for s in steps}
        unknown = set().union(*waiting.values(), set()) - set(by_name)
        if unknown:
            raise ValueError(f"unknown steps: {sorted(unknown)}")
        done: list[str] = []
        while waiting:
            ready = sorted(n for n, needs in waiting.items() if not needs - set(done))
            if not ready:
                raise ValueError(f"a cycle among {sorted(waiting)}")
            done += ready
            for n in ready:
                del waiting[n]
        return [by_name[n] for n in done]

    def run(self, steps: list[dict]) -> tuple[dict[str, DataFrame], str]:
        """(frames by step, weakest warrant); nothing is computed until a frame is used.

        A step of a specification seen before gives the frame kept for it.
        """
        out: dict[str, DataFrame] = {}
        keys: dict[str, str] = {}
        warrants = []
        for step in self.order(steps):
            kind = self.kinds.get(step["kind"])
            if kind is None:
                raise KeyError(f"unknown kind: {step['kind']}")
            inputs = list(step.get("from", ()))
            key = hashlib.sha256(json.dumps([step["kind"], step.get("spec", {}), [keys[i] for i in inputs]], sort_keys=True).encode()).hexdigest()
            if key not in self.memo:
                if len(self.memo) >= self.memo_size:
                    self.memo.pop(next(iter(self.memo)))
                self.memo[key] = kind.run(step.get("spec", {}), [out[i] for i in inputs])
            out[step["name"]], keys[step["name"]] = self.memo[key], key
            warrants.append(kind.warrant if kind.warrant in LADDER else LADDER[0])
        return out, min(warrants, key=LADDER.index) if warrants else LADDER[0]

    def seal(self, project: str, name: str, df: DataFrame, spec: dict) -> dict:
        """Compute a frame's content hash (free of order and partitioning) and chain a receipt for it."""
        cells = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in sorted(df.columns)])
        h = F.xxhash64(cells)
        row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 20)).alias("s")).first()
        previous = next((r["id"] for r in reversed(self.receipts) if r["project"] == project), None)
        body = {
            "project": project, "name": name, "rows": row["n"], "previous": previous,
            "inputs_sha": hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest(),
            "outputs_sha": hashlib.sha256(f"{row['n']}|{row['x']}|{row['s']}".encode()).hexdigest(),
        }
        receipt = body | {"id": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}
        self.receipts.append(receipt)
        return receipt

    def verify(self) -> bool:
        """Whether every receipt is what its hash says and follows the one before of its project."""
        last: dict[str, str] = {}
        for r in self.receipts:
            body = {k: v for k, v in r.items() if k != "id"}
            if r["previous"] != last.get(r["project"]) or r["id"] != hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest():
                return False
            last[r["project"]] = r["id"]
        return True
