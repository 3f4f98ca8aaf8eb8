"""URL filter over a sorted array of digests.

A rule is a host and a path prefix and holds for the host and its subdomains; the
longest fitting rule decides. All rules, and the words a host must not contain,
are kept in one file: their 64-bit xxhash keys in order, then the strings. A task
maps the file into memory, hashes every host suffix with every path prefix of a
length that some rule has, finds the keys by one binary search over the array for
a whole batch, and compares the stored string so that a collision can't match.

Rules given as a mapping make one file of at most ``MAX_BYTES``. A list of any size is a
table: Spark hashes its rows, deals them by the leading bits of their digests and sorts
them, which gives files of bounded size; the driver passes them on one at a time. Spark
brings files to each executor once (``addFile``); a batch asks each file for the digests
that lie in it.

A null url, or one without ``://``, has an empty host and path, fits no rule and
is allowed. Rows that repeat are judged once each. Of fitting rules of equal
length the one with the longer host decides. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import stored
from riskloom.session import work_dir

ALLOW, BLOCK = "allow", "block"
MAX_BYTES = 64 << 20

# Host words that mark a url no rule speaks of.
BLOCKED_WORDS = ("casino", "bets", "pills", "porn", "xxx", "viagra", "lottery", "payday", "torrent")

# A-Z alone is lower-cased.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = re.compile(r"[a-z0-9]+")
_WORD_KEY = "word="  # no rule contains "=" before its first "/"


def pack_index(entries: Mapping[str, str]) -> bytes:
    """Count, sorted keys, string ends, strings (key, tab, value)."""
    items = sorted((xxhash.xxh64_intdigest(k.encode()), f"{k}\t{v}".encode()) for k, v in entries.items())
    keys = np.array([k for k, _ in items], "<u8")
    ends = np.cumsum([len(s) for _, s in items], dtype="<u8") if items else np.empty(0, "<u8")
    data = struct.pack("<q", len(items)) + keys.tobytes() + ends.tobytes() + b"".join(s for _, s in items)
    if len(data) > MAX_BYTES:
        raise ValueError(f"the rules need {len(data)} bytes, more than {MAX_BYTES}")
    return data


class DigestIndex:
    """The file, mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view("<i8")[0])
        self.keys = raw[8:8 + 8 * n].view("<u8")
        self.ends = raw[8 + 8 * n:8 + 16 * n].view("<u8")
        self.data = raw[8 + 16 * n:]
        # Only the lengths of path prefixes and the longest host and word are held outside the file.
        lengths, self.longest_host, self.longest_word = set(), 0, 0
        for i in range(n):
            text = self._entry(i).partition(b"\t")[0].decode()
            if text.startswith(_WORD_KEY):
                self.longest_word = max(self.longest_word, len(text) - len(_WORD_KEY))
            else:
                self.longest_host = max(self.longest_host, text.index("/"))
                lengths.add(len(text) - text.index("/"))
        self.path_lengths = sorted(lengths)

    def _entry(self, i: int) -> bytes:
        start = int(self.ends[i - 1]) if i else 0
        return self.data[start:int(self.ends[i])].tobytes()

    def find(self, strings: list[str]) -> list[str | None]:
        """The value of each string, or None."""
        out: list[str | None] = [None] * len(strings)
        if not strings or not len(self.keys):
            return out
        coded = [s.encode("utf-8", "surrogatepass") for s in strings]
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, coded), np.uint64, len(coded))
        at = np.searchsorted(self.keys, wanted)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == wanted):
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == wanted[i]:
                key, _, value = self._entry(k).partition(b"\t")
                if key == coded[i]:
                    out[i] = value.decode()
                    break
                k += 1
        return out


def judge_batch(index: DigestIndex | ShardedIndex, hosts: list[str], paths: list[str]) -> tuple[list, list]:
    """The deciding rule (or None) and the verdict of each url."""
    owner, probes, word_owner, words = [], [], [], []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        if not host and not path:
            continue
        # A host that is longer than every rule's can end with one, no more.
        end = host[-index.longest_host - 1:] if index.longest_host else ""
        suffixes = [host] * (len(host) <= index.longest_host) + [end[m.end():] for m in re.finditer(r"\.", end)]
        prefixes = [path[:n] for n in index.path_lengths if n <= len(path)]
        for suffix in suffixes:
            probes += [suffix + p for p in prefixes]
        owner += [i] * (len(suffixes) * len(prefixes))
        found = {w for w in _WORD.findall(host) if len(w) <= index.longest_word}
        words += [_WORD_KEY + w for w in found]
        word_owner += [i] * len(found)
    rules: list[str | None] = [None] * len(hosts)
    verdicts = [ALLOW] * len(hosts)
    for i, value in zip(word_owner, index.find(words)):
        if value:
            verdicts[i] = value
    for i, probe, value in zip(owner, probes, index.find(probes)):
        # Suffixes come longest first, so the first of equal length has the longer host.
        if value and (rules[i] is None or len(probe) > len(rules[i])):
            rules[i], verdicts[i] = probe, value
    return rules, verdicts


class ShardedIndex:
    """Files of a list by the leading bits of digests, asked as one."""

    def __init__(self, shards: Mapping[int, DigestIndex], bits: int):
        self.shards, self.bits = shards, bits
        self.path_lengths = sorted(set().union(*(s.path_lengths for s in shards.values())))
        self.longest_host = max((s.longest_host for s in shards.values()), default=0)
        self.longest_word = max((s.longest_word for s in shards.values()), default=0)

    def find(self, strings: list[str]) -> list[str | None]:
        out: list[str | None] = [None] * len(strings)
        places: dict[int, list[int]] = {}
        for i, text in enumerate(strings):
            places.setdefault(shard_of(text, self.bits), []).append(i)
        for number, own in places.items():
            if number in self.shards:
                for i, value in zip(own, self.shards[number].find([strings[i] for i in own])):
                    out[i] = value
        return out


def shard_of(text: str, bits: int) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> (64 - bits) if bits else 0


_INDEXES: dict[tuple, ShardedIndex] = {}


def _index(names: tuple[tuple[int, str], ...], bits: int) -> ShardedIndex:
    """The files of these names, mapped once in each worker."""
    if names not in _INDEXES:
        _INDEXES[names] = ShardedIndex({n: DigestIndex(SparkFiles.get(name)) for n, name in names}, bits)
    return _INDEXES[names]


def check_rules(rules: DataFrame) -> None:
    """Raise if a row of the table is no rule."""
    host, key = F.substring_index("rule", "/", 1), F.col("rule")
    good = (
        key.contains("/") & (F.length(host) > 0) & ~host.contains("=") & ~key.contains("\t") & F.col("verdict").isin(ALLOW, BLOCK))
    wrong = rules.where(~F.coalesce(good, F.lit(False))).select("rule", "verdict").limit(1).collect()
    if wrong:
        raise ValueError(f"not a rule: {wrong[0]['rule']!r}: {wrong[0]['verdict']!r}")


def publish_table(rules: DataFrame) -> tuple[tuple[tuple[int, str], ...], int]:
    """Shards (number, file name) of a table of rules and verdicts, and the bits that deal them.

    Of rules that repeat the greatest verdict counts.
    """
    spark = rules.sparkSession
    rows = stored(rules.groupBy("rule").agg(F.max("verdict").alias("verdict")), "url-rule-table")
    size = rows.agg(F.sum(F.octet_length("rule") + F.octet_length("verdict") + 17)).first()[0] or 0
    # Half full on average, so that no shard outgrows its limit.
    bits = max(0, math.ceil(math.log2(max(1, 2 * size / MAX_BYTES))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [shard_of(t, bits) for t in batch["rule"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["rule"], batch["verdict"], pa.array(numbers, pa.int64())], ["rule", "verdict", "shard"])

    def pack(table: pa.Table) -> pa.Table:
        data = pack_index(dict(zip(table["rule"].to_pylist(), table["verdict"].to_pylist())))
        return pa.table({"shard": table["shard"][:1], "data": pa.array([data], pa.binary())})

    shards = rows.mapInArrow(place, "rule string, verdict string, shard bigint").groupBy("shard").applyInArrow(
        pack, "shard bigint, data binary")
    # One file at a time is with the driver.
    return tuple((r["shard"], publish_file(spark, bytes(r["data"]))) for r in stored(shards, "url-shards").toLocalIterator()), bits


def publish_file(spark: SparkSession, data: bytes) -> str:
    """Write an index to the shared folder and have executors fetch it; its file name."""
    name = f"url-rules-{xxhash.xxh3_128_hexdigest(data)}.idx"
    path = f"{work_dir(spark, 'url-rules')}/{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    if not any(str(f).endswith("/" + name) for f in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)
    return name


def filter_urls(
    pages: DataFrame, rules: Mapping[str, str] | DataFrame, blocked_words: tuple[str, ...] = BLOCKED_WORDS
) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``rules`` maps host and path, such as ``example.org/en/``, to a verdict, or is a table of
    rule and verdict for lists of any size.
    """
    words = {_WORD_KEY + w: BLOCK for w in blocked_words}
    if isinstance(rules, DataFrame):
        check_rules(rules)
        table = rules.select(F.col("rule").cast("string"), F.col("verdict").cast("string"))
        if words:
            table = table.unionByName(pages.sparkSession.createDataFrame(list(words.items()), "rule string, verdict string"))
        names, bits = publish_table(table)
    else:
        for rule, verdict in rules.items():
            host, slash, _ = rule.partition("/")
            if not slash or not host or "=" in host or "\t" in rule or verdict not in (ALLOW, BLOCK):
                raise ValueError(f"not a rule: {rule!r}: {verdict!r}")
        names, bits = ((0, publish_file(pages.sparkSession, pack_index({**rules, **words}))),), 0
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    split = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.translate(F.regexp_extract(url, parts, 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(url, parts, 2).alias("path"),
    )

    @F.arrow_udf("rule string, verdict string")
    def run(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        rules, verdicts = judge_batch(_index(names, bits), hosts.to_pylist(), paths.to_pylist())
        return pa.StructArray.from_arrays([pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                                          ["rule", "verdict"])

    return split.select("*", run("host", "path").alias("v")).select("page_id", "host", "path", "v.*")
