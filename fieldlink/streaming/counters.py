"""Service counters (E1, J8): what each batch of a service emitted, kept once per batch id.

A service whose batches run in ``foreachBatch`` counts the rows it emits with
a named observation in the write itself, so nothing is read or computed twice
for it, and records the number under the batch's id after the write. A retried
batch replaces its number. Services that write through the exactly-once file
sink are counted from what they wrote (``services.start_counters_service``):
their batches run in the engine, and a progress event that says how many rows
a batch had is lost if the driver ends right after the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fieldlink.sources import fs


def _folder(base: str, service: str) -> str:
    return f"{base}/service_counts/{service.lower().replace(' ', '_')}"


def observed(rows: DataFrame, service: str) -> tuple[DataFrame, Observation]:
    """``rows`` with an observation that counts them while they are written."""
    seen = Observation(f"{service} emitted")
    return rows.observe(seen, F.count(F.lit(1)).alias("n")), seen


def record(base: str, service: str, batch_id: int, n: int | Observation) -> None:
    """Keep a batch's number of rows; again for the same batch replaces it."""
    n = int(n.get["n"]) if isinstance(n, Observation) else int(n)
    fs.mkdirs(_folder(base, service))
    fs.write_text(f"{_folder(base, service)}/batch-{batch_id}.n", str(n))


def _files(folder: str) -> tuple[int, list[int], list[int]]:
    """Newest fold (-1: none), batch ids, fold ids."""
    ids = {"batch": [], "fold": []}
    for name, is_dir in fs.list_dir(folder):
        kind, _, rest = name.partition("-")
        if not is_dir and kind in ids and rest.endswith(".n"):
            ids[kind].append(int(rest[:-2]))
    return max(ids["fold"], default=-1), sorted(ids["batch"]), sorted(ids["fold"])


def total(base: str, service: str) -> int:
    """Rows that the service has emitted so far."""
    folder = _folder(base, service)
    done, batches, _ = _files(folder)
    names = [f"fold-{done}.n"] * (done >= 0) + [f"batch-{n}.n" for n in batches if n > done]
    return sum(int(fs.read_text(f"{folder}/{n}")) for n in names)


def fold(base: str, service: str) -> None:
    """Add up all batches but the newest, which may be retried, in one file; what was added up goes with the next call."""
    folder = _folder(base, service)
    done, batches, folds = _files(folder)
    for n in batches:
        if n <= done:
            fs.delete_file(f"{folder}/batch-{n}.n")
    for n in folds:
        if n < done:
            fs.delete_file(f"{folder}/fold-{n}.n")
    olds = [n for n in batches if n > done][:-1]
    if olds:
        names = [f"fold-{done}.n"] * (done >= 0) + [f"batch-{n}.n" for n in olds]
        fs.write_text(f"{folder}/fold-{olds[-1]}.n", str(sum(int(fs.read_text(f"{folder}/{n}")) for n in names)))
