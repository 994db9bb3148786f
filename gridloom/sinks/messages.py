"""Frames as messages: delta chunks, their envelope and the frame manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import constants as K
from gridloom.operators.frames import assign_chunks


def encode_delta_messages(deltas: DataFrame, chunk: int = K.CHUNK_CELLS, layer: str = K.DELTA_LAYER) -> DataFrame:
    """Messages ``(step, chunk, json)``; a group is one chunk, never more than ``chunk`` cells. Heights are written as they are."""
    ranked = assign_chunks(deltas, chunk, K.CHUNKS_PER_BATCH)
    cell = F.struct(F.col("risk").alias("state"), F.col("depth").alias("height"))
    cells = F.array_sort(F.collect_list(F.struct("idx", cell.alias("c"))))
    grouped = ranked.groupBy("step", "chunk").agg(cells.alias("a"))
    by_key = F.map_from_entries(F.transform("a", lambda s: F.struct(s["idx"].cast("string"), s["c"])))
    zero = F.struct(*[F.lit(0).alias(n) for n in "xyz"])
    body = F.struct(
        F.lit("EYE_SetState_Layer").alias("process"),
        F.lit(layer).alias("id"),
        F.struct(zero.alias("coord"), by_key.alias("cells")).alias("changes"),
    )
    return grouped.select("step", "chunk", F.to_json(body).alias("json"))


def frame_envelope(deltas: DataFrame, times: DataFrame, chunk: int = K.CHUNK_CELLS, batch: int = K.CHUNKS_PER_BATCH) -> DataFrame:
    """All messages of each step ``(step, rank, chunk, json)`` in sending order.

    Rank 0 is the start, 1 the chunks, 2 the end and 3 the sync with the simulation time.
    ``times`` is ``(step, sim_time)``; a step without changes still has start, end and sync.
    """
    counts = deltas.groupBy("step").agg(F.count(F.lit(1)).alias("_n"))
    heads = times.select("step", "sim_time").join(counts, "step", "left")
    total = F.floor((F.coalesce("_n", F.lit(0)) + (chunk - 1)) / chunk)
    message = lambda rank, *fields: F.struct(F.lit(rank).alias("rank"), F.to_json(F.struct(*fields)).alias("json"))
    kind = lambda name: F.lit(name).alias("process")
    control = heads.select(
        "step",
        F.inline(
            F.array(
                message(0, kind("FrameStart"), total.alias("total_chunks"), F.lit(batch).alias("chunks_per_batch")),
                message(2, kind("FrameEnd")),
                message(3, kind("EYE_Frame_Sync"), F.date_format("sim_time", "yyyy-MM-dd'T'HH:mm:ss").alias("simulation_time")),
            )
        ),
    ).withColumn("chunk", F.lit(0).cast("long"))
    data = encode_delta_messages(deltas, chunk).withColumn("rank", F.lit(1))
    cols = ["step", "rank", "chunk", "json"]
    return control.select(*cols).unionByName(data.select(*cols)).orderBy("step", "rank", "chunk")


def frame_manifest(frames: DataFrame, live: bool) -> DataFrame:
    """Ordered frame names and the live flag; the list holds one short name per frame."""
    names = frames.select("step").distinct().select(F.format_string("step_%05d", F.col("step")).alias("n"))
    return names.agg(F.array_sort(F.collect_list("n")).alias("frames")).withColumn("live", F.lit(live))
