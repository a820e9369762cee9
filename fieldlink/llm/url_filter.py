"""URL filters: a sorted array of 64-bit digests, probed by vectorised binary search.

A rule is a host and the beginning of a path. The file of a rule set holds the
XXH64 digests of its rules in order, then the rules themselves; workers map it
into memory, look up digests of all hosts and host-and-path beginnings of a
batch at once, and compare the stored rule with the URL, so that a digest that
two strings share can't decide.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from fieldlink.llm.common import ascii_lower, staged, unused
from fieldlink.session import ensure_checkpoint_dir
from fieldlink.sources import fs

#: Rule sets up to this many bytes become a file on every worker; larger ones are joined.
MOST_BYTES = 256 << 20
#: host, path and verdict of the registered query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
URL = r"://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; then up to ``?`` or ``#``."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


class Digests:
    """A sorted array of digests over byte strings, with the strings to compare."""

    def __init__(self, keys: np.ndarray, ends: np.ndarray, blob: np.ndarray):
        self.keys, self.ends, self.blob = keys, ends, blob

    @staticmethod
    def sections(strings: list[bytes], digest=xxh64_intdigest) -> tuple[list[int], list[np.ndarray]]:
        """The order of ``strings`` by digest, and the arrays of the file."""
        keys = np.array([digest(s) for s in strings], np.uint64)
        order = np.argsort(keys, kind="stable").tolist()
        ordered = [strings[i] for i in order]
        ends = np.cumsum([0, *map(len, ordered)]).astype(np.uint64)
        return order, [keys[order], ends, np.frombuffer(b"".join(ordered), np.uint8)]

    def string(self, at: int) -> bytes:
        return self.blob[int(self.ends[at]) : int(self.ends[at + 1])].tobytes()

    def find(self, strings: list[bytes], digest=xxh64_intdigest) -> list[int]:
        """Place of each string in the array, -1 if it is not there."""
        keys = np.array([digest(s) for s in strings], np.uint64)
        out = np.full(len(strings), -1)
        if len(self.keys) and len(strings):
            low = np.searchsorted(self.keys, keys)
            near = np.minimum(low, len(self.keys) - 1)
            for i in np.flatnonzero(self.keys[near] == keys).tolist():
                at = int(low[i])
                while at < len(self.keys) and self.keys[at] == keys[i]:
                    if self.string(at) == strings[i]:
                        out[i] = at
                        break
                    at += 1
        return out.tolist()


class RuleSet:
    """Rules in a file: digests of rules and of their hosts, and the lengths of the paths that each host has."""

    MAGIC = 0x75726C31

    def __init__(self, data: np.ndarray, digest=xxh64_intdigest):
        self.digest = digest
        head = data[:64].view(np.uint64)
        if len(data) < 64 or int(head[0]) != self.MAGIC:
            raise ValueError("not a rule file")
        n, rule_bytes, hosts, host_bytes, lengths = (int(x) for x in head[1:6])
        at = 64

        def take(count: int, kind) -> np.ndarray:
            nonlocal at
            size = count * np.dtype(kind).itemsize
            part = data[at : at + size].view(kind)
            at += -(-size // 8) * 8
            return part

        self.rules = Digests(take(n, np.uint64), take(n + 1, np.uint64), take(rule_bytes, np.uint8))
        self.blocks = take(n, np.uint8)
        self.hosts = Digests(take(hosts, np.uint64), take(hosts + 1, np.uint64), take(host_bytes, np.uint8))
        self.starts, self.lengths = take(hosts + 1, np.uint64), take(lengths, np.uint64)
        self.longest = int(np.diff(self.hosts.ends).max()) if hosts else 0

    @classmethod
    def build(cls, rules: list[tuple[str, str, str]], digest=xxh64_intdigest) -> bytes:
        """The file's bytes. Of rules that repeat a host and path ``block`` stands."""
        kept: dict[tuple[bytes, bytes], bool] = {}
        for host, path, verdict in rules:
            key = (host.encode(), path.encode())
            kept[key] = kept.get(key, False) or verdict == "block"
        by_host: dict[bytes, set[int]] = {}
        for host, path in kept:
            by_host.setdefault(host, set()).add(len(path))
        order, sections = Digests.sections([h + p for h, p in kept], digest)
        flags = list(kept.values())
        host_order, host_sections = Digests.sections(list(by_host), digest)
        lengths = [sorted(list(by_host.values())[i], reverse=True) for i in host_order]
        sections += [np.array([flags[i] for i in order], np.uint8), *host_sections,
                     np.cumsum([0, *map(len, lengths)]).astype(np.uint64),
                     np.array([x for xs in lengths for x in xs], np.uint64)]
        head = [cls.MAGIC, len(kept), len(sections[2]), len(by_host), len(host_sections[2]), len(sections[-1]), 0, 0]
        parts = [np.array(head, np.uint64).tobytes()]
        for s in sections:
            raw = s.tobytes()
            parts.append(raw + b"\0" * (-len(raw) % 8))
        return b"".join(parts)

    def judge(self, hosts: list[bytes], paths: list[bytes]) -> list[tuple[bytes, bool] | None]:
        """For each host and path the longest rule that fits and whether it blocks, or None."""
        known: dict[bytes, list[tuple[bytes, list[int]]]] = {h: [] for h in set(hosts)}
        asked, of = [], []
        for host in known:
            # The host, then what follows each of its dots; nothing longer than the longest host of a rule.
            at = 0 if len(host) <= self.longest else host.find(b".", len(host) - self.longest - 1) + 1 or len(host)
            while at < len(host) or not host:
                asked.append(host[at:])
                of.append(host)
                at = host.find(b".", at) + 1
                if not at:
                    break
        for host, suffix, at in zip(of, asked, self.hosts.find(asked, self.digest)):
            if at >= 0:
                lengths = self.lengths[int(self.starts[at]) : int(self.starts[at + 1])].tolist()
                known[host].append((suffix, lengths))
        tries, row = [], []
        for i, (host, path) in enumerate(zip(hosts, paths)):
            for suffix, lengths in known[host]:
                for n in lengths:
                    if n <= len(path):
                        tries.append(suffix + path[:n])
                        row.append(i)
        out: list[tuple[bytes, bool] | None] = [None] * len(hosts)
        for i, rule, at in zip(row, tries, self.rules.find(tries, self.digest)):
            if at >= 0 and (out[i] is None or len(rule) > len(out[i][0])):
                out[i] = (rule, bool(self.blocks[at]))
        return out


_OPEN: dict[str, RuleSet] = {}


def _rule_set(name: str) -> RuleSet:
    """The worker's rule file, mapped into memory; all workers of a machine share its pages."""
    if name not in _OPEN:
        from pyspark import SparkFiles

        _OPEN.clear()
        _OPEN[name] = RuleSet(np.memmap(SparkFiles.get(name), np.uint8, "r"))
    return _OPEN[name]


def _publish(spark: SparkSession, data: bytes) -> str:
    """Write the rule file to the shared folder and have Spark send it to the workers."""
    name = f"url-rules-{uuid.uuid4().hex}"
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm"
    fs.mkdirs(folder)
    store, path = fs.resolve(f"{folder}/{name}")
    with store.open_output_stream(path) as out:
        out.write(data)
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """Rules as ``host, path, verdict``; hosts lower-cased (A-Z), a null path read as empty, no rule without a host or verdict."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    return rules.select(ascii_lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where(
        "host IS NOT NULL AND verdict IN ('allow', 'block')")


def _probed(rows: DataFrame, rules: DataFrame, default: str, host: str, path: str, rule: str, verdict: str) -> DataFrame:
    spark = rows.sparkSession
    name = _publish(spark, RuleSet.build([tuple(r) for r in rules.collect()]))
    keep = rows.columns
    h, p = unused(rows, "__h"), unused(rows, "__p")
    wide = rows.select("*", F.col(host).cast("binary").alias(h), F.col(path).cast("binary").alias(p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule_set = _rule_set(name)
        for batch in batches:
            found = rule_set.judge(batch.column(h).to_pylist(), batch.column(p).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep],
                 pa.array([f and f[0].decode() for f in found], pa.string()),
                 pa.array([default if f is None else "block" if f[1] else "allow" for f in found], pa.string())],
                [*keep, rule, verdict])

    added = [T.StructField(rule, T.StringType()), T.StructField(verdict, T.StringType())]
    return wide.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))


def _joined(rows: DataFrame, rules: DataFrame, default: str, host: str, path: str, rule: str, verdict: str) -> DataFrame:
    """The same by joins, for rule sets that are too large for a file on every worker.

    Distinct hosts and paths are looked up: the ends of a host among the
    rules' hosts, then the path's beginnings of the lengths which that host
    has. The results are written before they are joined back to the rows, so
    a URL that many rows share is split.
    """
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block stands
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths"))
    urls = rows.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct()
    # No end of a host that is longer than the longest host of a rule.
    longest = rules.agg(F.coalesce(F.max(F.length("host")), F.lit(0))).first()[0]
    ends = urls.withColumn("t", F.expr(f"right(h, {longest + 1})")).select("h", "p", F.explode(F.expr(
        "filter(transform(sequence(1, size(split(t, '[.]'))), i -> substring_index(t, '.', -i)), "
        "x -> length(h) = length(t) OR length(x) < length(t))")).alias("host"))
    tries = (ends.join(lengths, "host").select("h", "p", "host", F.explode("lengths").alias("n"))
             .where("n <= length(p)").select("h", "p", "host", F.expr("substring(p, 1, n)").alias("path")))
    best = tries.join(rules, ["host", "path"]).groupBy("h", "p").agg(
        F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"),
                 F.struct(F.octet_length("host") + F.octet_length("path"), F.octet_length("host"))).alias("best"))
    best = staged(best.select("h", "p", "best.*"), "url-verdicts").toDF(*(unused(rows, c) for c in ("__h", "__p", "__rule", "__verdict")))
    h, p, found, decided = best.columns
    back = rows.join(best, (rows[host] == best[h]) & (rows[path] == best[p]), "left")
    return back.select(*rows.columns, F.col(found).alias(rule), F.coalesce(decided, F.lit(default)).alias(verdict))


def judge(pages: DataFrame, rules, default: str = "allow", url_col: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` added (underscores where a column has that name).

    A rule fits its host and all subdomains if the path begins with the
    rule's; of several the longest (host and path together, in bytes) decides,
    of two as long the one with the longer host, of rules with the same host
    and path ``block``. Where none fits, ``rule`` is null
    and the verdict is ``default``. A null URL or one without ``://`` has an
    empty host and path, which fit no rule but one with an empty host.
    ``rules``: rows ``(host, path, verdict)``, as a list or a DataFrame; their
    size is checked, and sets over ``most_bytes`` are joined instead of sent
    to the workers. Rows, repeated ones too, are kept as they are; no shuffle
    in the first way.
    """
    spark = pages.sparkSession
    known = rule_table(spark, rules)
    host, path, rule, verdict = (unused(pages, c) for c in ("host", "path", "rule", "verdict"))
    h, p = host_and_path(pages[url_col])
    rows = pages.select("*", h.alias(host), p.alias(path))
    size = known.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 32), F.lit(0))).first()[0]
    way = _probed if size <= most_bytes else _joined
    return way(rows, known, default, host, path, rule, verdict)


def op13_url_filters(spark, sf_dir: str) -> DataFrame:
    """Contract query: the host, path, rule and verdict of every page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP13_SQL = """
WITH u AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path,
  (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM r
   WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
  coalesce((SELECT arg_max(rverdict, length(rhost || rpath)) FROM r
   WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM u
"""
