"""Models as functions over rows. A model is any callable that a task can make: ``load()`` gives a function from a pandas
frame of prompts to a frame of answers. Rules around it (second prompts, checks, fallbacks) are DataFrame operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelyard.functions import text as T

from .evaluation import answers_checked, best_names

Model = Callable[[pd.DataFrame], pd.DataFrame]
MASKS = "key string, prompt string, item int, score double, area long, pixels array<bigint>"


def applied(rows: DataFrame, load: Callable[[], Model], schema: str) -> DataFrame:
    """A model's answers; it is loaded once for each task's worker, and rows come to it in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for b in batches:
            model = model or load()
            yield model(b)

    return rows.mapInPandas(run, schema)


def segmented(prompts: DataFrame, load: Callable[[], Model]) -> DataFrame:
    """Masks (see MASKS, and ``used``) for text prompts (key, prompt). A door handle is asked for a second time as one that turns;
    those masks are taken if their area is over 0 and below the first ones'."""
    second = prompts.withColumn("second", T.second_prompt(F.col("prompt")))
    one = applied(prompts.select("key", "prompt"), load, MASKS).withColumn("used", F.col("prompt"))
    two = applied(second.filter("second is not null").select("key", F.col("second").alias("prompt")), load, MASKS).withColumn("used", F.col("prompt"))
    two = two.join(second.filter("second is not null").select("key", F.col("second").alias("used"), F.col("prompt").alias("asked")).distinct(), ["key", "used"]).withColumn("prompt", F.col("asked")).drop("asked").select(*one.columns)
    total = lambda df, name: df.groupBy("key", "prompt").agg(F.sum("area").alias(name))
    better = total(two, "second").join(total(one, "first"), ["key", "prompt"], "left").filter((F.col("second") > 0) & (F.col("second") < F.col("first"))).select("key", "prompt")
    return one.join(better, ["key", "prompt"], "left_anti").unionByName(two.join(better, ["key", "prompt"], "left_semi"))


def tracked(seeds: DataFrame, frames: DataFrame, load: Callable[[], Model]) -> DataFrame:
    """Masks through a video: (key, seed, frame, object, area, pixels). A seed (key, seed, prompt) starts at the first frame
    that gives a mask; its k-th object is seed * 1000 + k. The model gets (key, seed, prompt, frames), a video at a
    time, and answers (key, seed, frame, k, area, pixels)."""
    schema = "key string, seed long, frame long, k long, area long, pixels array<bigint>"
    video = frames.groupBy("key").agg(F.sort_array(F.collect_list("frame")).alias("frames"))
    said = applied(seeds.join(video, "key"), load, schema).filter("area > 0")
    first = said.groupBy("key", "seed").agg(F.min("frame").alias("start"))
    return said.join(first, ["key", "seed"]).filter("frame >= start").select("key", "seed", "frame", (F.col("seed") * 1000 + F.col("k")).alias("object"), "area", "pixels")


ANSWER = "struct<choice:struct<id:string,name:string,type:string>,score:string,candidates:array<struct<id:string,name:string,type:string,score:string>>>"


def grounded(asked: DataFrame, nodes: DataFrame, load: Callable[[], Model], most: int = 3) -> DataFrame:
    """(query, id, name, type, score, rank, source, error) of instructions (query, text, objects, spatial) over nodes (id, name,
    type). A model answers (query, answer) with a text that holds a JSON object: for spatial ones a single choice,
    else candidates. Answers whose id, name and type aren't a node's are left out; a query without any gets the
    nodes whose names fit its objects; error says why."""
    said = applied(asked.select("query", "text", "spatial"), load, "query long, answer string").join(asked.select("query", "spatial"), "query")
    obj = T.first_object(F.col("answer"))
    read = said.withColumn("obj", obj).withColumn("a", F.from_json("obj", ANSWER))
    one = F.array(F.struct(F.col("a.choice.id").alias("id"), F.col("a.choice.name").alias("name"), F.col("a.choice.type").alias("type"), F.col("a.score").alias("score")))
    rows = read.select("query", F.posexplode(F.when(F.col("spatial"), F.when(F.col("a.choice").isNotNull(), one)).otherwise(F.slice(F.col("a.candidates"), 1, 3))).alias("place", "c"))
    rows = rows.select("query", "place", T.whole_id(F.col("c.id")).alias("id"), F.trim("c.name").alias("name"), F.trim("c.type").alias("type"), T.clamp01(F.col("c.score")).alias("score"))
    good = answers_checked(rows, nodes, most).withColumn("source", F.lit("model")).withColumn("error", F.lit(None).cast("string"))
    why = F.when(F.col("obj").isNull(), "no object").when(F.col("a").isNull(), "not json").when(F.col("spatial") & F.col("a.choice").isNull(), "no choice").otherwise("no valid answer")
    lost = read.join(good.select("query").distinct(), "query", "left_anti").select("query", why.alias("error"))
    tokens = asked.join(lost.select("query"), "query", "left_semi").select("query", F.explode(F.transform("objects", T.plain_words)).alias("token")).distinct()
    names = nodes.select("id", T.plain_words(F.col("name")).alias("name"))
    found = best_names(tokens, names, most).join(nodes.select("id", "name", "type"), "id").withColumn("source", F.lit("name"))
    found = lost.join(found, "query", "left").select("query", "id", "name", "type", "score", "rank", "source", "error")
    return good.select(*found.columns).unionByName(found)
