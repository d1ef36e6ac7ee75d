"""References whose target is missing, deleted or arrives later.

The ledger moves on batch by batch over keyed state.  Parents and references
lie in buckets of the parent's key; a batch of parents reads the buckets it
touches and no others, writes the keys that changed, and has the references on
these judged again.  References that come in probe the parents.  Open orphans
(and the last state of records that have states) are one keyed table that a
batch merges with its own verdicts.  After each batch they are counted per
table, field and period.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.scratch import delete, scratch_path

_PARENT = "kind int, key bigint, seen timestamp_ntz, born timestamp_ntz, gone timestamp_ntz, b int"
_REF = "kind int, ref_table string, ref_field string, rec_key bigint, ref_key bigint, at timestamp_ntz, seen timestamp_ntz, versioned boolean"
_VERDICT = "ref_table string, ref_field string, rec_key bigint, ref_key bigint, at timestamp_ntz, seen timestamp_ntz, versioned boolean, epoch int, reason string"
_REASONS = ("", "missing", "deleted", "late")  # the first stands for none
_FEW = 100_000  # parents of a kind that may be broadcast


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _reason(has_parent: Column, born: Column, gone: Column, at: Column) -> Column:
    return (
        F.when(~has_parent, F.lit("missing"))
        .when(gone <= at, F.lit("deleted"))
        .when(born > at, F.lit("late"))
    )


def parents(df: DataFrame, kind: int, key: str, born: str, gone: str, seen: str | None = None) -> DataFrame:
    """Parent states of one kind; the greatest ``seen`` of a key counts."""
    at = F.col(seen) if seen else F.lit(None)
    cols = [F.lit(kind).cast("int").alias("kind"), F.col(key).cast("bigint").alias("key"), at.cast("timestamp_ntz").alias("seen")]
    cols += [F.col(c).cast("timestamp_ntz").alias(a) for c, a in ((born, "born"), (gone, "gone"))]
    return df.select(*cols).where(F.col("key").isNotNull())


def references(df: DataFrame, kind: int, table: str, name: str, record: str, at: str, seen: str | None = None, versioned: bool = False) -> DataFrame:
    """References of column ``name``; null is no reference.

    ``versioned`` records have states: the one with the greatest ``seen``
    replaces the others, and a state without a reference takes it back.
    """
    cols = [
        F.lit(kind).cast("int").alias("kind"), F.lit(table).alias("ref_table"), F.lit(name).alias("ref_field"),
        F.col(record).cast("bigint").alias("rec_key"), F.col(name).cast("bigint").alias("ref_key"),
        F.col(at).cast("timestamp_ntz").alias("at"), (F.col(seen) if seen else F.lit(None)).cast("timestamp_ntz").alias("seen"),
        F.lit(versioned).alias("versioned"),
    ]
    out = df.select(*cols)
    return out if versioned else out.where(F.col("ref_key").isNotNull())


@dataclass
class OrphanLedger:
    """Pending-orphan state over batches of references and parent states.

    Repeated rows are harmless.  Rows with a null key are no parents, null
    references are no references, and a null time satisfies no comparison, so
    such a reference can only be ``missing``.  Empty batches are allowed.
    """

    spark: SparkSession
    home: str = ""
    epoch: int = 0
    buckets: int = 16
    merge_after: int = 8
    _most: dict[int, int] = field(default_factory=dict)  # per kind, no fewer than the parents it has

    def __post_init__(self) -> None:
        self.home = self.home or scratch_path(self.spark, "orphans")

    def _read(self, name: str, schema: str, epochs: list[int], buckets: list[int] | None = None) -> DataFrame:
        if not epochs or buckets == []:
            return self.spark.createDataFrame([], schema)
        root = f"{self.home}/{name}"
        rows = self.spark.read.schema(schema).option("basePath", root).parquet(*(f"{root}/v={e}" for e in epochs)).drop("v")
        return rows if buckets is None else rows.where(F.col("b").isin(buckets))

    def _write(self, df: DataFrame, name: str, by: str | None = None) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.home}/{name}/v={self.epoch}")

    def _bucket(self, kind: str, key: str) -> Column:
        return F.pmod(F.xxhash64(key, kind), F.lit(self.buckets)).cast("int").alias("b")

    def _parents(self, upto: int, buckets: list[int] | None = None) -> DataFrame:
        """The last state of every parent after batch ``upto``: the last merged table and what changed since."""
        merged = upto // self.merge_after * self.merge_after
        rows = self._read("parents", _PARENT, list(range(merged + 1, upto + 1)), buckets)
        if merged:
            rows = rows.unionByName(self._read("merged", _PARENT, [merged], buckets))
        return rows.groupBy("kind", "key", "b").agg(F.max(F.struct("seen", "born", "gone")).alias("s")).select("kind", "key", "s.*", "b")

    def _judged(self, refs: DataFrame, against: DataFrame, how: str, few: list[int]) -> DataFrame:
        """References with their verdict; kinds with few parents are broadcast, so their hot keys are not shuffled."""
        parent = against.select(F.col("kind").alias("p_kind"), F.col("key").alias("p_key"), "born", "gone")
        on = (F.col("ref_key") == F.col("p_key")) & (F.col("kind") == F.col("p_kind"))
        many = refs.where(~F.col("kind").isin(few)).join(parent.where(~F.col("p_kind").isin(few)), on, how)
        small = refs.where(F.col("kind").isin(few)).join(F.broadcast(parent.where(F.col("p_kind").isin(few))), on, how)  # at most _FEW rows a kind
        verdict = _reason(F.col("p_key").isNotNull(), F.col("born"), F.col("gone"), F.col("at"))
        return (many.unionByName(small) if few else many).withColumn("reason", F.when(F.col("ref_key").isNotNull(), verdict))

    def advance(self, new_references: DataFrame, new_parents: DataFrame) -> int:
        """Apply one batch; replaying the same batch number overwrites it."""
        before = self.epoch
        self.epoch += 1
        # parents: only keys whose state moves on are written
        came = new_parents.groupBy("kind", "key").agg(F.max(F.struct("seen", "born", "gone")).alias("new")).withColumn("b", self._bucket("kind", "key"))
        self._write(came, "came")
        came = self._read("came", "kind int, key bigint, new struct<seen timestamp_ntz, born timestamp_ntz, gone timestamp_ntz>, b int", [self.epoch])
        met = came.groupBy("kind", "b").agg(F.count("*").alias("n")).collect()  # at most kinds times ``buckets`` rows
        touched = sorted({r["b"] for r in met})
        for r in met:
            self._most[r["kind"]] = self._most.get(r["kind"], 0) + r["n"]
        few = [k for k, n in self._most.items() if n <= _FEW]
        old = self._parents(before, touched).select("kind", "key", F.struct("seen", "born", "gone").alias("was"))
        newer = came.join(old, ["kind", "key"], "left").where(F.col("was").isNull() | (F.col("new") > F.col("was")))
        moved = F.col("was").isNull() | ~F.struct("new.born", "new.gone").eqNullSafe(F.struct("was.born", "was.gone"))
        self._write(newer.select("kind", "key", "new.*", moved.alias("moved"), "b"), "parents", "b")
        if self.epoch % self.merge_after == 0:
            previous, self_rows = self.epoch - self.merge_after, self._read("parents", _PARENT, list(range(self.epoch - self.merge_after + 1, self.epoch + 1)))
            whole = self_rows.unionByName(self._read("merged", _PARENT, [previous])) if previous else self_rows
            self._write(whole.groupBy("kind", "key", "b").agg(F.max(F.struct("seen", "born", "gone")).alias("s")).select("kind", "key", "s.*", "b"), "merged", "b")
        index = self._parents(self.epoch)
        # references that come in
        self._write(new_references.withColumn("b", self._bucket("kind", "ref_key")), "refs", "b")
        mine = self._read("refs", f"{_REF}, b int", [self.epoch])
        verdicts = self._judged(mine, index, "left", few).where(F.col("reason").isNotNull() | F.col("versioned"))
        # references that rest on, or wait for, a parent that moved
        changed = self._read("parents", f"{_PARENT}, moved boolean", [self.epoch]).where("moved")
        if before:
            again = self._judged(self._read("refs", f"{_REF}, b int", list(range(1, before + 1)), touched), changed, "inner", few)
            verdicts = verdicts.unionByName(again)
        verdicts = verdicts.withColumn("epoch", F.lit(self.epoch).cast("int")).select(*_names(_VERDICT))
        if before:
            verdicts = verdicts.unionByName(self._read("state", _VERDICT, [before]))
        # a reference without states is itself its key, so the last verdict is the greatest of one number
        code = F.col("epoch").cast("bigint") * len(_REASONS) + F.array_position(F.array(*map(F.lit, _REASONS)), F.coalesce("reason", F.lit(""))) - 1
        plain = verdicts.where(~F.col("versioned")).groupBy("ref_table", "ref_field", "rec_key", "ref_key", "at").agg(F.max(code).alias("code"))
        plain = plain.withColumn("reason", F.get(F.array(*map(F.lit, _REASONS)), (F.col("code") % len(_REASONS)).cast("int")))
        # one that is fine now is judged again when its parent moves, and needs no row
        plain = plain.where("reason <> ''").select("ref_table", "ref_field", "rec_key", "ref_key", "at", F.lit(None).cast("timestamp_ntz").alias("seen"), F.lit(False).alias("versioned"), (F.col("code") / len(_REASONS)).cast("int").alias("epoch"), "reason")
        last = F.max(F.struct("seen", "ref_key", "at", "epoch", "reason")).alias("s")
        states = verdicts.where("versioned").groupBy("ref_table", "ref_field", "rec_key").agg(last).select("ref_table", "ref_field", "rec_key", "s.ref_key", "s.at", "s.seen", F.lit(True).alias("versioned"), "s.epoch", "s.reason")
        self._write(plain.unionByName(states), "state")
        delete(self.spark, f"{self.home}/state/v={before - 1}")
        delete(self.spark, f"{self.home}/came/v={self.epoch}")
        self._write(self.open().groupBy("ref_table", "ref_field", "ref_period", "reason").agg(F.count("*").alias("n_open")), "counts")
        return self.epoch

    def open(self) -> DataFrame:
        """The references that are orphans now, one row each."""
        state = self._read("state", _VERDICT, [self.epoch] if self.epoch else [])
        return state.where(F.col("reason").isNotNull()).select("ref_table", "ref_field", F.date_format("at", "yyyy-MM").alias("ref_period"), "rec_key", "ref_key", "reason")

    def history(self) -> DataFrame:
        """The counts of open orphans after every batch, as ``v`` (batch), table, field, period, reason, ``n_open``."""
        schema = "ref_table string, ref_field string, ref_period string, reason string, n_open bigint, v int"
        if not self.epoch:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.home}/counts")
