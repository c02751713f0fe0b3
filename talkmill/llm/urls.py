"""URL rules in a memory-mapped sorted array of 64-bit digests.

A rule is (verdict, host, path). It fits its host and all subdomains if the URL's path starts with the rule's path; the longest
fitting rule wins, then the one with the longer host. The index file holds the sorted xxhash keys, the rules and the path
lengths in use. Every executor maps it once, so its Python workers share the pages. A URL probes all (host suffix, path
prefix) keys of a batch in one vectorised binary search, and each hit is confirmed against the stored full strings, so that
equal digests of different strings decide nothing.

A null URL, or one without ``://``, has an empty host and path, fits no rule and gets the default verdict. Repeated rows are
judged each; only the id and the URL are read. No shuffle takes place, so a frequent host costs nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.llm.common import new_folder

#: A rule set is configuration. Its file goes to every executor, so a larger one is refused, never cut.
MAX_INDEX_BYTES = 1 << 30
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``, ``#`` or the end."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return (
        F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


def pack(rules: Iterable[Rule], digest=None) -> bytes:
    """The index file: eight bytes with the size of the JSON head, the head, zeros up to a multiple of eight, the keys, the strings."""
    import xxhash

    digest = digest or xxhash.xxh64_intdigest
    rows = sorted({(digest(host + path), verdict, host, path) for verdict, host, path in rules})
    names = [h + p for _, _, h, p in rows]
    if len(set(names)) < len(names):
        raise ValueError("a host and path has two verdicts")
    if bad := [p for _, _, _, p in rows if not p.startswith("/")]:
        raise ValueError(f"a rule's path starts with a slash: {bad[0]!r}")
    strings = [json.dumps([v, h, p]).encode() for _, v, h, p in rows]
    offsets = np.cumsum([0, *map(len, strings)]).astype("<u8")
    head = json.dumps({"n": len(rows), "lengths": sorted({len(p) for _, _, _, p in rows})}).encode()
    head += b" " * (-len(head) % 8)
    keys = np.array([k for k, *_ in rows], dtype="<u8")
    data = len(head).to_bytes(8, "little") + head + keys.tobytes() + offsets.tobytes() + b"".join(strings)
    if len(data) > MAX_INDEX_BYTES:
        raise ValueError(f"the rules take {len(data)} bytes; at most {MAX_INDEX_BYTES} are sent to every executor")
    return data


class RuleIndex:
    """The mapped file."""

    def __init__(self, path: str, digest=None):
        import xxhash

        self.digest = digest or xxhash.xxh64_intdigest
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        size = int.from_bytes(raw[:8].tobytes(), "little")
        head = json.loads(raw[8:8 + size].tobytes())
        n, at = head["n"], 8 + size
        self.lengths = head["lengths"]
        self.keys = raw[at:at + 8 * n].view("<u8")
        self.offsets = raw[at + 8 * n:at + 16 * n + 8].view("<u8")
        self.strings = raw[at + 16 * n + 8:]

    def rule(self, n: int) -> Rule:
        return tuple(json.loads(self.strings[int(self.offsets[n]):int(self.offsets[n + 1])].tobytes()))

    def find(self, hosts: list[str], paths: list[str]) -> list[Rule | None]:
        """The longest fitting rule of each URL."""
        keys, owners, parts = [], [], []
        for n, (host, path) in enumerate(zip(hosts, paths)):
            dot = 0 if host else -1
            prefixes = [path[:size] for size in self.lengths if size <= len(path)]
            while prefixes and dot >= 0:
                suffix = host[dot:]
                for prefix in prefixes:
                    keys.append(self.digest(suffix + prefix))
                    owners.append(n)
                    parts.append((suffix, prefix))
                dot = host.find(".", dot) + 1 or -1
        best: list[Rule | None] = [None] * len(hosts)
        if not keys or not len(self.keys):
            return best
        wanted = np.array(keys, dtype=np.uint64)
        left, right = np.searchsorted(self.keys, wanted, "left"), np.searchsorted(self.keys, wanted, "right")
        for k in np.flatnonzero(left < right).tolist():
            for place in range(left[k], right[k]):
                rule = self.rule(place)
                if rule[1:] == parts[k] and longer(rule, best[owners[k]]):
                    best[owners[k]] = rule
        return best


def longer(rule: Rule, than: Rule | None) -> bool:
    measure = lambda r: (len(r[1]) + len(r[2]), len(r[1]))
    return than is None or measure(rule) > measure(than)


def publish(spark: SparkSession, data: bytes) -> str:
    """Write the file to the shared folder, let Spark copy it to every executor, and return its name there."""
    folder = new_folder(spark, "url-rules")
    name = folder.rsplit("/", 1)[1]
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def judge(pages: DataFrame, rules: Iterable[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule (host and path as one string, or null), verdict."""
    name = publish(pages.sparkSession, pack(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(SparkFiles.get(name))
        for batch in batches:
            found = index.find(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r and r[1] + r[2] for r in found], pa.string()),
                 pa.array([r[0] if r else default for r in found], pa.string())],
                [key, "host", "path", "rule", "verdict"],
            )

    host, path = host_and_path(F.col(url).cast("string"))
    rows = pages.select(key, host.alias("host"), path.alias("path"))
    return rows.mapInArrow(run, rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit("").alias("verdict")).schema)
