"""Event log to grid as a stream, with the batch operators inside each micro-batch.

State lives in versioned folders of the shared store. A manifest per batch, written last, names every version that
the next batch builds on; what no manifest names was never committed. A batch that is run again after a failure starts
from the manifest before it, or finds its own and does nothing. A version that a manifest names and that is gone is an
error, never an empty table. Nothing is keyed to one task per scenario: a micro-batch of one busy scenario is spread
over the cluster like any other.
"""

from __future__ import annotations

import json
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.functions import store
from gridloom.functions.cells import div
from gridloom.functions.running import running
from gridloom.operators import events as ev

TAIL = "scenario string, seq bigint, ts timestamp, json string"
MARKS = "scenario string, eof bigint, done bigint"
GRID = "scenario string, idx bigint, risk int, depth double, frame_end bigint"
FRAMES = "scenario string, frame_end bigint, seq bigint, pos int, idx bigint, risk int, depth double"
TILES = "scenario string, tile bigint, version string"
#: Versions that tiles may be spread over before a compaction writes all of them anew.
MOST_VERSIONS = 8
_STATE = ("marks", "tail", "base", "tiles")


def manifest(spark: SparkSession, path: str, batch_id: int | None = None) -> dict | None:
    """What is committed after a batch, or after the last one; None before the first."""
    if batch_id is None:
        done = [int(n[:-5]) for n in store.names(spark, f"{path}/manifest") if n.endswith(".json")]
        if not done:
            return None
        batch_id = max(done)
    return json.loads(store.read_small(spark, f"{path}/manifest/{batch_id}.json")) if batch_id >= 0 else None


def _read(spark: SparkSession, path: str, name: str | None, schema: str) -> DataFrame:
    """A version that a manifest names; an empty table where it names none."""
    return spark.read.schema(schema).parquet(f"{path}/{name}") if name else spark.createDataFrame([], schema)


def decode_sink(path: str):
    """Batch function that splits each micro-batch into good events and the dead letter."""

    def write(batch: DataFrame, batch_id: int) -> None:
        cached = batch.persist()
        good, dead = ev.decode(cached)
        good.write.mode("overwrite").parquet(f"{path}/good/batch={batch_id}")
        dead.write.mode("overwrite").parquet(f"{path}/dead/batch={batch_id}")
        cached.unpersist()

    return write


class FrameFold:
    """Commits frames incrementally and keeps the current grid.

    Between batches only two things are carried: the events of each scenario after its last frame
    boundary (the pending part of an open frame), and the first Init_EOF. Rows that arrive at or below
    an already committed position go to a late table instead of changing the past; of rows that repeat a
    ``(scenario, seq)`` one counts. With ``dense_from`` set, ``seq`` has no gaps from that number on, and rows behind a
    gap wait in the carried part until the missing ones arrive. Versions that only older manifests name are removed.
    """

    def __init__(self, path: str, rows: int, cols: int, limit_seconds: float | None = None, file_mode: bool = False,
                 dense_from: int | None = None, compact_every: int = 20, tile: int = 1 << 16):
        self.path, self.rows, self.cols = path, rows, cols
        self.limit, self.file_mode, self.dense_from = limit_seconds, file_mode, dense_from
        self.compact_every, self.tile = compact_every, tile

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if store.exists(spark, f"{self.path}/manifest/{batch_id}.json"):
            return
        last = manifest(spark, self.path, batch_id - 1) or {"batch": -1, "marks": None, "tail": None, "base": None, "frames": False}
        marks = _read(spark, self.path, last["marks"], MARKS)
        tail = _read(spark, self.path, last["tail"], TAIL)

        rows = batch.select("scenario", "seq", "ts", "json").unionByName(tail).join(marks, "scenario", "left").drop("eof")
        is_late = F.coalesce(F.col("seq") <= F.col("done"), F.lit(False))
        # One micro-batch feeds several writes; kept on disk it is decoded once.
        rows = ev.parse(rows.withColumn("_late", is_late).drop("done")).persist(StorageLevel.DISK_ONLY)
        work = rows.filter("not _late").drop("_late")
        # repeats are looked for on two narrow columns; only a batch that has some is dealt by them
        per = rows.groupBy("scenario", "seq", "_late").agg(F.count(F.lit(1)).alias("n"))
        late, repeated = per.agg(F.count_if("_late"), F.count_if((F.col("n") > 1) & ~F.col("_late"))).first()
        if late:
            rows.filter("_late").drop("_late", "process").write.mode("overwrite").parquet(f"{self.path}/late/batch={batch_id}")
        if repeated:
            work = work.dropDuplicates(["scenario", "seq"])
        ready, held = self._split_at_gap(work, marks)

        good = ready.filter(F.col("process").isNotNull())
        eof = self._eof(good, marks) if self.file_mode else None
        segments = ev.frame_segments(good, self.limit, eof)
        changes = ev.frame_changes(ev.committed_messages(good, segments), self.rows, self.cols)
        changes.drop("row", "col").write.mode("overwrite").parquet(f"{self.path}/frames/batch={batch_id}")
        done = {"batch": batch_id, "frames": True, "base": last["base"], **self._carry(ready, held, marks)}
        rows.unpersist()
        if (batch_id + 1) % self.compact_every == 0:
            done["base"] = self._compact(spark, done)
        store.write_small(spark, f"{self.path}/manifest/{batch_id}.json", json.dumps(done))
        self._retain(spark, [last, done])

    def _new(self, kind: str) -> str:
        return f"{kind}/v-{uuid.uuid4().hex}"

    def _retain(self, spark: SparkSession, kept: list[dict]) -> None:
        """Remove the versions that none of these manifests names, those of lost attempts too, and older manifests."""
        used = {m[k] for m in kept for k in ("marks", "tail")}
        for base in (m["base"] for m in kept if m["base"]):
            used |= {base["tiles"], *base["parts"]}
        for kind in _STATE:
            for name in store.names(spark, f"{self.path}/{kind}"):
                if f"{kind}/{name}" not in used:
                    store.remove(spark, f"{self.path}/{kind}/{name}")
        for name in store.names(spark, f"{self.path}/manifest"):
            if name.endswith(".json") and int(name[:-5]) < kept[0]["batch"]:
                store.remove(spark, f"{self.path}/manifest/{name}")

    def _split_at_gap(self, work: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        if self.dense_from is None:
            return work, None
        # A row is ready when as many rows precede it, counted from the carried base, as seq says.
        base = marks.select("scenario", F.col("done").alias("_base"))
        one = F.lit(1).cast("long")
        numbered = running(work, ["scenario"], "seq", {"_n": ("sum", one)}).join(base, "scenario", "left")
        gapless = F.col("seq") == F.coalesce("_base", F.lit(self.dense_from - 1)) + F.col("_n")
        return numbered.filter(gapless).drop("_n", "_base"), numbered.filter(~gapless).drop("_n", "_base")

    @staticmethod
    def _eof(good: DataFrame, marks: DataFrame) -> DataFrame:
        both = marks.select("scenario", "eof").unionByName(ev.first_init_eof(good))
        return both.groupBy("scenario").agg(F.min("eof").alias("eof")).filter(F.col("eof").isNotNull())

    def _carry(self, ready: DataFrame, held: DataFrame | None, marks: DataFrame) -> dict[str, str]:
        p = F.col("process")
        now = ready.groupBy("scenario").agg(
            F.min(F.when(p == "Init_EOF", F.col("seq"))).alias("eof"),
            F.max(F.when(p == "FrameEnd", F.col("seq"))).alias("done"),
            F.max(F.when(p == "FrameStart", F.col("seq"))).alias("_open"),
        )
        # Everything up to the last FrameEnd is final; an open frame starts over at its FrameStart.
        spark = marks.sparkSession
        both = marks.withColumn("_open", F.lit(None).cast("long")).unionByName(now)
        merged = both.groupBy("scenario").agg(F.min("eof").alias("eof"), F.max("done").alias("done"), F.max("_open").alias("_open"))
        named = {"marks": self._new("marks"), "tail": self._new("tail")}
        final = F.greatest(F.col("done"), F.col("_open") - 1)
        merged.select("scenario", "eof", final.alias("done")).write.parquet(f"{self.path}/{named['marks']}")
        stored = _read(spark, self.path, named["marks"], MARKS)
        rest = ready.join(stored, "scenario", "left").filter(F.col("done").isNull() | (F.col("seq") > F.col("done"))).select(
            "scenario", "seq", "ts", "json"
        )
        if held is not None:
            rest = rest.unionByName(held.select("scenario", "seq", "ts", "json"))
        rest.write.parquet(f"{self.path}/{named['tail']}")
        return named

    def _compact(self, spark: SparkSession, done: dict) -> dict:
        """New versions of the tiles that changed since the last compaction; the others stay where they are.

        Where tiles would be spread over too many versions, all are written anew.
        """
        base = done["base"]
        tiled = lambda df: df.withColumn("tile", div(F.col("idx"), self.tile).cast("long"))
        fresh = tiled(_frames(spark, self.path, base["upto"] + 1 if base else 0, done["batch"]))
        latest, index = last_writes(fresh.drop("tile")), spark.createDataFrame([], TILES)
        if base:
            old = _base(spark, self.path, base)
            if len(base["parts"]) < MOST_VERSIONS:
                touched = fresh.select("scenario", "tile").distinct()
                old = old.join(touched, ["scenario", "tile"], "left_semi")
                index = _read(spark, self.path, base["tiles"], TILES).join(touched, ["scenario", "tile"], "left_anti")
            latest = last_writes(latest.unionByName(old.select(*_columns(GRID))))
        version = self._new("base")
        tiled(latest).repartition("scenario", "tile").sortWithinPartitions("scenario", "idx").write.parquet(f"{self.path}/{version}")
        written = spark.read.schema(f"{GRID}, tile bigint").parquet(f"{self.path}/{version}").select("scenario", "tile").distinct()
        tiles = self._new("tiles")
        index.unionByName(written.withColumn("version", F.lit(version))).write.parquet(f"{self.path}/{tiles}")
        parts = sorted(r[0] for r in _read(spark, self.path, tiles, TILES).select("version").distinct().collect())
        return {"upto": done["batch"], "tiles": tiles, "parts": parts}


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _base(spark: SparkSession, path: str, base: dict) -> DataFrame:
    """Rows ``GRID`` and tile of the versions in force: a row counts where the index of tiles names its version."""
    rows = spark.read.schema(f"{GRID}, tile bigint").parquet(*[f"{path}/{p}" for p in base["parts"]])
    rows = rows.withColumn("version", F.regexp_extract(F.col("_metadata.file_path"), "/(base/v-[0-9a-f]+)/", 1))
    return rows.join(_read(spark, path, base["tiles"], TILES), ["scenario", "tile", "version"], "left_semi").drop("version")


def _frames(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    return spark.read.schema(FRAMES + ", batch int").parquet(f"{path}/frames").filter(F.col("batch").between(first, last)).drop("batch")


def committed_frames(spark: SparkSession, path: str) -> DataFrame:
    """Changes of all committed batches; what a batch wrote before it was committed does not count."""
    done = manifest(spark, path)
    return _frames(spark, path, 0, done["batch"]) if done else spark.createDataFrame([], FRAMES)


def last_writes(frames: DataFrame) -> DataFrame:
    """Latest value per cell; a write without depth keeps the last depth that was given.

    Later frames hold later writes, so the order of writes is also that of frames.
    """
    at = ev.write_order() if "seq" in frames.columns else F.col("frame_end")
    return frames.groupBy("scenario", "idx").agg(
        F.max_by("risk", at).alias("risk"),
        F.max_by("depth", F.when(F.col("depth").isNotNull(), at)).alias("depth"),
        F.max("frame_end").alias("frame_end"),
    )


def current_grid(spark: SparkSession, path: str) -> DataFrame:
    """Grid after the last committed batch: the tiles' versions in force, merged with the changes since."""
    done = manifest(spark, path)
    if done is None:
        return spark.createDataFrame([], GRID)
    base = done["base"]
    fresh = last_writes(_frames(spark, path, base["upto"] + 1 if base else 0, done["batch"]))
    return last_writes(_base(spark, path, base).select(*_columns(GRID)).unionByName(fresh)) if base else fresh


def run_fold(stream: DataFrame, fold: FrameFold, checkpoint: str) -> StreamingQuery:
    """Start the fold over all available input; await it with a time limit."""
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
