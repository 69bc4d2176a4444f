"""Text from blocks of any depth against a plain recursive walk."""

import json
import random

from pyspark.sql import functions as F

from threadloom.functions import blocks
from threadloom.sources import logs


def plain(value):
    def walk(x):
        if isinstance(x, str):
            return [x.strip()] if x.strip() else []
        if isinstance(x, list):
            return [t for i in x for t in walk(i)]
        if isinstance(x, dict):
            own = [x["text"].strip()] if isinstance(x.get("text"), str) and x["text"].strip() else []
            return own + [t for k in ("content", "message", "input", "output") if k in x for t in walk(x[k])]
        return []

    return "\n".join(walk(value))


def made(rnd, depth):
    kind = rnd.choice(["text", "list", "dict", "other"]) if depth else "text"
    if kind == "text":
        return rnd.choice(["a", " b ", "", "é\n", "日本", f"t{rnd.random():.3f}"])
    if kind == "other":
        return rnd.choice([None, 3, True, 1.5])
    if kind == "list":
        return [made(rnd, depth - 1) for _ in range(rnd.randint(0, 3))]
    return {k: made(rnd, depth - 1) for k in rnd.sample(["text", "content", "message", "input", "output", "type", "id"], rnd.randint(0, 4))}


def nested(levels):
    value = "the bottom"
    for i in range(levels):
        value = [{"type": "tool_result", "text": f"level {i}", "content": value}] if i % 2 else {"output": value}
    return value


def test_walk_equals_recursion():
    rnd = random.Random(3)
    for _ in range(400):
        value = made(rnd, 5)
        assert blocks.walked(value) == plain(value)
    assert blocks.walked(nested(40)) == plain(nested(40)) and blocks.walked(nested(40)).endswith("the bottom")
    deep = nested(5000)
    assert blocks.walked(deep).count("\n") == 2500


def test_logs_keep_text_of_any_depth(spark, tmp_path):
    rnd = random.Random(9)
    contents = [nested(40), nested(1), "plain", [{"type": "text", "text": "one"}, {"type": "text", "text": "two"}], [{"type": "tool_result", "content": [{"content": [{"text": "inner"}]}, "x"]}]]
    contents += [[made(rnd, 4) for _ in range(3)] for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps({"message": {"content": c}})) for i, c in enumerate(contents)], "i int, line string").withColumn("v", F.try_parse_json("line"))
    got = {r.i: r.t for r in df.select("i", logs.content_text(F.col("v"), "$.message.content").alias("t")).collect()}
    assert {i: (t or "") for i, t in got.items()} == {i: plain(c) for i, c in enumerate(contents)}
