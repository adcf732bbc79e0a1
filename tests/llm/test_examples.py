"""Examples of chat formatting: their bounds are read and checked."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pitscore.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def expanded(spark):
    rng = random.Random(4)
    rows = [(c, k, rng.choice(["user", "assistant", "tool"]), rng.choice(["a</s>", "b [INST]", "\\", "", "é\n"]) * rng.randint(0, 3)) for c in range(40) for k in range(rng.randint(1, 9))]
    rows += [(99, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(3000)]  # one conversation holds most turns
    return spark.createDataFrame(rows, TURNS).repartition(4).transform(chat.expand), rows


def test_examples_end_with_their_reply(expanded):
    df, rows = expanded
    few = df.where("conv_id < 40")
    texts = {(r.conv_id, r.example): r for r in chat.example_texts(few).collect()}
    bounds = {(r.conv_id, r.example): r for r in few.where("example is not null").collect()}
    assert set(texts) == set(bounds) and len(texts) == sum(r[2] == "assistant" and r[0] < 40 for r in rows)
    for key, r in texts.items():
        assert len(r.text) == bounds[key].prefix_end and r.text.endswith("</s>") and r.text[: r.loss_start].endswith("<s>")


def test_streamed_and_shuffled_readings_agree(expanded):
    df, rows = expanded
    one, two = (sorted(map(tuple, chat.read_back(x, s).collect())) for x, s in ((df, True), (df.repartition(5), False)))
    assert one == two and len(one) == 41
    got = next(r for r in one if r[0] == 99)
    replies = "".join(f"turn {k}" for k in range(1, 3000, 2))
    assert got[1] == 3000 and got[3] == len(replies) and got[4] == hashlib.sha256(replies.encode()).hexdigest()


@pytest.mark.parametrize("column, change", [("prefix_end", 1), ("loss_start", -1), ("loss_end", 1), ("example", 1), ("start", 1)])
def test_wrong_bounds_are_errors(expanded, column, change):
    df = expanded[0].where("conv_id < 40")
    wrong = df.withColumn(column, F.when(F.col("conv_id") == 7, F.col(column) + change).otherwise(F.col(column)))
    with pytest.raises(Exception, match="does not end with its reply|out of place"):
        chat.read_back(wrong).collect()


def test_lost_examples_are_errors(expanded):
    gone = F.when(F.col("conv_id") != 99, F.col("example"))
    with pytest.raises(Exception, match="not in the right examples"):
        chat.read_back(expanded[0].withColumn("example", gone)).collect()
