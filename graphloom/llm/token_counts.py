"""Delta-maintained token totals by source, language and tokenizer version.

A batch is a set of signed changes: an insert adds a document and its tokens, a delete takes them
away, a revised count adds the difference. Totals are additive, so a batch is first reduced to one
delta for each (source, lang, tokenizer) and only that is kept; totals are the sum of the deltas.

Commits are idempotent. A batch's delta is written whole to a folder of its own attempt, and the batch counts from the
moment when a folder named by the batch id appears, which holds one entry, the attempt's name. That folder is made complete under
another name and renamed, so a crash leaves all of it or nothing; the file system renames only once, since the target is
never empty, and a writer that comes second finds its entry one level deeper, where nobody looks. A batch that is sent again, after a crash
or twice, finds the folder and changes nothing; attempts without one are never read.

Totals are kept as a base and the deltas since. After FOLD deltas, the base and they are summed to a new base, published in the
same way under the next number together with the ids of the batches that it holds. So totals read one base and
fewer than about FOLD deltas, however many batches there were; the driver lists batch ids, never rows. A crash while
folding leaves the old base in force.

The file system must rename folders atomically, as HDFS and local disks do.

Null sources and languages are groups of their own; null and empty texts count 0 tokens; repeated
rows count as often as they occur; an empty batch commits an empty delta. Columns of documents other than the id, source,
language and text are not read, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored, table, word_count

KEYS = ["source", "lang", "tokenizer"]
INSERT, DELETE, REVISE = "insert", "delete", "revise"
CHANGES = "op string, source string, lang string, tokenizer string, old_tokens bigint, new_tokens bigint"
#: Open deltas that are folded into a new base.
FOLD = 32
DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_changes bigint"


def delta(changes: DataFrame) -> DataFrame:
    """One row for each key: the change of documents and tokens. Partial sums are formed before the shuffle.

    changes: CHANGES; an insert has new_tokens, a delete old_tokens, a revision both. Other ops are an error.
    """
    op, old, new = F.col("op"), F.coalesce("old_tokens", F.lit(0)), F.coalesce("new_tokens", F.lit(0))
    docs = F.when(op == INSERT, 1).when(op == DELETE, -1).when(op == REVISE, 0).otherwise(F.raise_error(F.concat(F.lit("no such change: "), F.coalesce(op, F.lit("null")))).cast("int"))
    tokens = F.when(op == INSERT, new).when(op == DELETE, -old).otherwise(new - old)
    return changes.groupBy(*KEYS).agg(F.sum(docs.cast("long")).alias("n_docs"), F.sum(tokens).alias("n_tokens"), F.count(F.lit(1)).alias("n_changes"))


class Rollup:
    """Totals kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, fold: int = FOLD) -> None:
        self.spark, self.path, self.fold = spark, path.rstrip("/"), fold
        self._to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._to(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for folder in ("commits", "bases"):
            self._fs.mkdirs(self._to(f"{self.path}/{folder}"))

    def _names(self, folder: str) -> list[str]:
        """The visible entries of a folder."""
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._to(f"{self.path}/{folder}"))) if not n.startswith("."))

    def _publish(self, place: str, entry: str) -> bool:
        """Makes the folder ``place`` appear with one entry; False if there is one already."""
        target, made = self._to(f"{self.path}/{place}"), self._to(f"{self.path}/{place.split('/')[0]}/.{uuid.uuid4().hex}")
        if self._fs.exists(target):
            return False
        self._fs.mkdirs(self._to(made, entry))
        self._fs.rename(made, target)
        return self._names(place) == [entry]

    def committed(self) -> dict[str, str]:
        """Attempt by batch id."""
        return {batch: self._names(f"commits/{batch}")[0] for batch in self._names("commits")}

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commits a batch; False, without a change, if it was committed before."""
        if not batch_id or not all(c.isalnum() or c in "._-" for c in batch_id) or batch_id.startswith((".", "_")):
            raise ValueError(f"not a batch id: {batch_id!r}")
        if self._fs.exists(self._to(f"{self.path}/commits/{batch_id}")):
            return False
        attempt = f"{batch_id}-{uuid.uuid4().hex}"
        delta(changes).write.parquet(f"{self.path}/deltas/{attempt}")
        if not self._publish(f"commits/{batch_id}", attempt):
            return False  # another writer was first
        if len(self._open()[1]) >= self.fold:
            self.compact()
        return True

    def _open(self) -> tuple[str | None, dict[str, str]]:
        """(folder of the base in force, attempts by batch id that it doesn't hold)."""
        numbers = self._names("bases")
        base = None
        held: set[str] = set()
        if numbers:
            last = max(numbers, key=int)
            base = f"{self.path}/folded/{self._names(f'bases/{last}')[0]}"
            held = {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{base}/batches").collect()}
        new = [b for b in self._names("commits") if b not in held]
        return base, {b: self._names(f"commits/{b}")[0] for b in new}

    def compact(self) -> None:
        """Folds the open deltas into a new base."""
        numbers = self._names("bases")
        base, new = self._open()
        attempt = uuid.uuid4().hex
        path = f"{self.path}/folded/{attempt}"
        self._sum(self._rows(base, new)).coalesce(1 + len(new) // 64).write.parquet(f"{path}/totals")
        held = self.spark.createDataFrame([(b,) for b in new], "batch string")
        (held.unionByName(self.spark.read.schema("batch string").parquet(f"{base}/batches")) if base else held).write.parquet(f"{path}/batches")
        self._publish(f"bases/{max(map(int, numbers), default=0) + 1}", attempt)  # another writer's base is as good

    def _rows(self, base: str | None, new: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/deltas/{a}" for a in sorted(new.values())] + ([f"{base}/totals"] if base else [])
        return self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)

    @staticmethod
    def _sum(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_changes").alias("n_changes"))

    def totals(self) -> DataFrame:
        """Current totals; keys whose documents have all gone stay out."""
        return self._sum(self._rows(*self._open())).filter("n_docs <> 0 OR n_tokens <> 0")


#: Version 1 takes runs without blanks as tokens, version 2 counts UTF-8 bytes.
WORDS_V1, BYTES_V2 = "words-1", "bytes-2"


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, words, bytes) of every row of docs."""
    return docs.select("doc_id", "source", "lang", word_count(F.col("text")).alias("words"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))


def changes(op: str, rows: DataFrame, versions: dict[str, tuple[Column | None, Column | None]]) -> DataFrame:
    """CHANGES of one kind: a row for each row (source, lang, ...) and version, with its old and new tokens."""
    none = F.lit(None).cast("long")
    each = [F.struct(F.lit(k).alias("tokenizer"), (none if old is None else old.cast("long")).alias("old_tokens"), (none if new is None else new.cast("long")).alias("new_tokens")) for k, (old, new) in versions.items()]
    return rows.select(F.lit(op).alias("op"), "source", "lang", F.inline(F.array(*each)))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The life of a rollup over all documents and labels.

    All documents are inserted with both versions, and that batch is sent twice. Then documents that
    a label calls toxic are deleted, and those whose quality label is 0 have their word counts revised
    to letters' worth: four bytes a word, rounded up. Rows that repeat an id are all changed. Two open deltas are folded, so the totals come from a base and a delta.
    """
    counts = stored(counted(table(spark, sf_dir, "documents")), "counts")
    words, size = F.col("words"), F.col("bytes")
    rollup = Rollup(spark, scratch(spark, "rollup"), fold=2)
    insert = changes(INSERT, counts, {WORDS_V1: (None, words), BYTES_V2: (None, size)})
    rollup.apply("0001-insert", insert)
    rollup.apply("0001-insert", insert)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    toxic = counts.join(labels.filter("toxic = 1"), "doc_id", "left_semi")
    rollup.apply("0002-delete", changes(DELETE, toxic, {WORDS_V1: (words, None), BYTES_V2: (size, None)}))
    poor = counts.join(labels.filter("quality = 0 AND coalesce(toxic, 0) <> 1"), "doc_id", "left_semi")
    rollup.apply("0003-revise", changes(REVISE, poor, {WORDS_V1: (words, F.ceil(size / 4))}))
    return rollup.totals()


ORACLE_SQL = rf"""
WITH l AS (
  SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id
), d AS (
  SELECT source, lang, coalesce(toxic, 0) AS toxic, coalesce(quality, 1) = 0 AND coalesce(toxic, 0) <> 1 AS poor,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes
  FROM documents LEFT JOIN l USING (doc_id)
), c AS (
  SELECT source, lang, '{WORDS_V1}' AS tokenizer, toxic, CASE WHEN poor THEN ceil(bytes / 4.0)::BIGINT ELSE words END AS tokens, poor FROM d
  UNION ALL SELECT source, lang, '{BYTES_V2}', toxic, bytes, false FROM d
)
SELECT source, lang, tokenizer, count(*) FILTER (toxic <> 1) AS n_docs, coalesce(sum(tokens) FILTER (toxic <> 1), 0)::BIGINT AS n_tokens,
  (count(*) + count(*) FILTER (toxic = 1) + count(*) FILTER (poor))::BIGINT AS n_changes
FROM c GROUP BY source, lang, tokenizer HAVING count(*) FILTER (toxic <> 1) <> 0
"""
