"""Token counts as delta-maintained rollups with idempotent batch commits."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swipeline.llm.common import cut, discard
from swipeline.llm.tokens import encoder

KEYS = ["source", "lang", "tokenizer"]
DELTAS = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long, part int"
SUMS = "source string, lang string, tokenizer string, docs long, tokens long"
#: An entry is a batch with its mark, or a compaction of the batches from ``batch`` to ``last`` with the folder of their marks.
MANIFEST = "version long, batch long, last long, folder string, mark string, marks string"


def document_counts(docs: DataFrame, vocabulary: str | None = None, tokenizer: str = "byte_bpe_50k/1", revised: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, tokens, revised, tokenizer) of every row of ``docs``: how many tokens the whole text has, a null text none.

    ``revised`` is another wording of the text, null where it is the same; its count is in the column revised, the text's own where it is null.
    Both are counted in one pass. Texts of any length are read whole; a null source or lang is a value; other columns play no part; an empty table gives no rows.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            counts = [len(encode(t.as_py() or "")) for t in batch.column("text")]
            again = [n if not t.is_valid else len(encode(t.as_py())) for t, n in zip(batch.column("again"), counts, strict=True)]
            keys = [batch.column(c) for c in ("doc_id", "source", "lang")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(counts, pa.int64()), pa.array(again, pa.int64())], ["doc_id", "source", "lang", "tokens", "revised"])

    again = F.lit(None).cast("string") if revised is None else revised
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text", again.alias("again"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokens long, revised long").withColumn("tokenizer", F.lit(tokenizer))


def added(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")


class TokenRollup:
    """Totals by source, language and tokenizer version, kept up to date by signed deltas in a folder.

    Each batch has a folder of its own with what it changes: ``deltas`` by document and key, in ``parts`` parts by a hash of the document, and ``sums`` of these by key. The totals are the
    sums of the batches' sums, so they need neither texts nor documents, and a commit reads of earlier deltas only the parts that its documents are in. A commit writes new folders and last of all a new manifest, which
    says the folders that count; one that fails half-way leaves the totals as they were, and nothing is ever overwritten. Batches have rising
    numbers. Committing a batch again changes nothing if its changes are the same; the last one may be given again with other
    changes, which replace it; an earlier one with other changes, or a new number below the last, is refused, as later batches build on it.

    Only the newest manifest is read. A commit that makes more than ``most_live`` batches adds all but the last up in one folder (``compact`` adds up all), and their marks go to a file of their own: a manifest has at most
    ``most_live`` + 2 entries, so what is read does not grow with the number of batches. Folders and manifests that no longer count are removed then, once they are ``grace_s`` seconds old, so
    that a reader who began before can end. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 64, most_live: int = 64, grace_s: int = 3600):
        self.spark, self.path, self.parts, self.most_live, self.grace_s = spark, path, parts, most_live, grace_s

    def listed(self, folder: str) -> list[tuple[str, int]]:
        """(name, milliseconds of its last change) of what is in a folder; nothing if it is not there."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [(f.getPath().getName(), f.getModificationTime()) for f in files.listStatus(where)] if files.exists(where) else []

    def manifests(self) -> list[tuple[int, str]]:
        """(version, name) of the manifests, newest first."""
        return sorted(((int(name.split("-")[0]), name) for name, _ in self.listed(f"{self.path}/manifest")), reverse=True)

    def entries(self) -> list:
        """The rows of the newest whole manifest, by batch."""
        whole = [m for m in self.manifests()[:4] if any(name == "_SUCCESS" for name, _ in self.listed(f"{self.path}/manifest/{m[1]}"))]
        if not whole:
            return []
        if len(whole) > 1 and whole[0][0] == whole[1][0]:
            raise RuntimeError("two writers have committed at once")
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/{whole[0][1]}").orderBy("batch").collect()

    def publish(self, version: int, entries: list[tuple]) -> None:
        rows = self.spark.createDataFrame([(version, *e) for e in entries], MANIFEST)
        rows.coalesce(1).write.json(f"{self.path}/manifest/{version:012d}-{uuid.uuid4().hex}")

    def read(self, part: str, schema: str, entries: list) -> DataFrame:
        paths = sorted({f"{self.path}/{part}/folder={e['folder']}" for e in entries})
        columns = [c.split()[0] for c in schema.split(", ")]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{part}").parquet(*paths).select(columns) if paths else self.spark.createDataFrame([], schema)

    def part_of(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.parts)).cast("int")

    def write(self, deltas: DataFrame) -> str:
        folder = uuid.uuid4().hex
        parted = deltas.select("doc_id", *KEYS, "docs", "tokens", self.part_of().alias("part")).repartitionByRange("part", "doc_id")
        parted.write.partitionBy("part").parquet(f"{self.path}/deltas/folder={folder}")
        added(self.read("deltas", DELTAS, [{"folder": folder}]), *KEYS).write.parquet(f"{self.path}/sums/folder={folder}")
        return folder

    def mark_of(self, batch: int, entries: list) -> str | None:
        """The mark with which a batch was committed, None if it was not."""
        for e in entries:
            if e["marks"] is None and e["batch"] == batch:
                return e["mark"]
            if e["marks"] is not None and e["batch"] <= batch <= e["last"]:
                found = self.spark.read.parquet(f"{self.path}/marks/{e['marks']}").filter(F.col("batch") == batch).first()
                return found and found["mark"]
        return None

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Adds the deltas of ``changes``: doc_id and op, and for inserts and revisions source, lang, tokenizer and tokens.

        insert adds a document's count (its rows are added up; repeated rows are repeated documents); delete takes away all
        that earlier batches say of a document; revise does both. A delete or revision of an unknown document takes nothing
        away. Null keys are keys of their own; rows with a null doc_id or op are inserts if they
        say so and otherwise change nothing; other columns play no part. Sums by document come before sums by key, so a hot source is combined before the shuffle.
        """
        names = set(changes.columns)
        given = cut(
            changes.select(
                F.col("doc_id").cast("long").alias("doc_id"), "op", *((F.col(c) if c in names else F.lit(None)).cast("string").alias(c) for c in KEYS),
                (F.col("tokens") if "tokens" in names else F.lit(0)).cast("long").alias("tokens"),
            )
        )
        mark = ":".join(map(str, given.agg(F.count("*"), *(F.sum(F.xxhash64(*given.columns, F.lit(k)).cast("decimal(38,0)")) for k in (0, 1))).first()))
        entries = self.entries()
        if self.mark_of(batch, entries) == mark:
            return
        if any(e["last"] > batch or (e["last"] == batch and e["marks"] is not None) for e in entries):
            raise ValueError(f"batch {batch} has other changes than before, or is new, and later ones or a compaction build on what it was")
        before = [e for e in entries if e["last"] < batch]
        plus = given.filter(F.col("op").isin("insert", "revise")).groupBy("doc_id", *KEYS).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
        gone = given.filter(F.col("op").isin("delete", "revise")).select("doc_id").distinct()
        touched = [r["part"] for r in gone.filter("doc_id IS NOT NULL").select(self.part_of().alias("part")).distinct().collect()]
        earlier = self.read("deltas", DELTAS, before).filter(F.col("part").isin(touched))
        known = added(earlier.join(gone, "doc_id", "left_semi"), "doc_id", *KEYS)
        minus = known.select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
        folder = self.write(added(plus.unionByName(minus), "doc_id", *KEYS))
        kept = [tuple(e)[1:] for e in before]
        self.publish(max((e["version"] for e in entries), default=0) + 1, [*kept, (batch, batch, folder, mark, None)])
        if sum(e["marks"] is None for e in before) + 1 > self.most_live:
            self.fold(1)

    def compact(self) -> None:
        """Adds all batches' deltas up in one folder. Their numbers and marks stay known, so a replay of any still changes nothing."""
        self.fold(0)

    def fold(self, leave: int) -> None:
        """Adds all but the last ``leave`` batches up, and removes what no longer counts."""
        entries = self.entries()
        folded, live = entries[: len(entries) - leave], entries[len(entries) - leave :]
        if sum(e["marks"] is None for e in folded):
            folder, marks = self.write(added(self.read("deltas", DELTAS, folded), "doc_id", *KEYS)), f"{uuid.uuid4().hex}"
            told = self.spark.createDataFrame([(e["batch"], e["mark"]) for e in folded if e["marks"] is None], "batch long, mark string")
            for e in folded:
                if e["marks"] is not None:
                    told = told.unionByName(self.spark.read.parquet(f"{self.path}/marks/{e['marks']}"))
            told.repartitionByRange(1, "batch").write.parquet(f"{self.path}/marks/{marks}")
            self.publish(entries[0]["version"] + 1, [(folded[0]["batch"], folded[-1]["last"], folder, None, marks), *(tuple(e)[1:] for e in live)])
        self.sweep()

    def sweep(self) -> None:
        """Removes folders and manifests that the newest manifest does without, once they are old enough."""
        entries = self.entries()
        folders, until = {f"folder={e['folder']}" for e in entries}, time.time() * 1000 - self.grace_s * 1000
        counts = {"deltas": folders, "sums": folders, "marks": {e["marks"] for e in entries}, "manifest": {name for _, name in self.manifests()[:1]}}
        for kind, needed in counts.items():
            for name, at in self.listed(f"{self.path}/{kind}"):
                if name not in needed and at <= until:
                    discard(self.spark, f"{self.path}/{kind}/{name}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) of the keys that have documents."""
        return added(self.read("sums", SUMS, self.entries()), *KEYS)
