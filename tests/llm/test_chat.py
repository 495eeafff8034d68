"""Round trips of the template, the examples, and odd rows."""

import hashlib
import random
import re

from lattica.llm import chat, queries
from tests.llm.oracle import same_as_sql

SF = "/root/testdata/sf0.01"


def test_query_equals_sql(spark):
    same_as_sql(spark, SF, "op9_chat_format", queries)


def test_escaping_is_reversible_and_hides_marks(spark):
    rng = random.Random(2)
    parts = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "a", "<s>", "</s>", "[INST]", "[/INST]", "\n", "$1", "é"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select("t", chat.escaped(df.t).alias("e"), chat.unescaped(chat.escaped(df.t)).alias("u")).collect()
    assert all(r.t == r.u and not re.search(r"</?s>|\[/?INST\]", r.e) for r in got)


def test_examples(spark):
    rows = [(1, 0, "system", "be kind"), (1, 2, "assistant", "one"), (1, 1, "user", "hi"), (1, 3, "user", "more"), (1, 4, "assistant", "two"), (1, 5, "user", "left"),
            (2, 0, "user", "alone"), (3, None, None, None), (3, 1, "assistant", ""), (None, 0, "assistant", "x"), (4, 1, "assistant", "a"), (4, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as t", "2 as last")
    got = chat.examples(df).orderBy("conv_id", "example").collect()
    one = [r for r in got if r.conv_id == 1]
    assert [r.text[r.loss_start:r.loss_end] if r.loss_start is not None else None for r in one] == ["one", "two", None]
    assert one[1].text.startswith(one[0].text) and one[2].text.startswith(one[1].text)
    back = {r.conv_id: r for r in chat.read_back(chat.examples(df)).collect()}
    said = "".join(f"{r}\n{t}\n" for r, t in [("system", "be kind"), ("user", "hi"), ("assistant", "one"), ("user", "more"), ("assistant", "two"), ("user", "left")])
    assert back[1].n_turns == 6 and back[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert back[1].loss_sha256 == hashlib.sha256(b"onetwo").hexdigest() and back[1].loss_chars == 6
    assert back[2].loss_chars == 0 and back[2].n_turns == 1
    assert back[3].turns_sha256 == hashlib.sha256(b"\n\nassistant\n\n").hexdigest() and back[3].n_turns == 2
    assert back[None].loss_chars == 1 and back[4].loss_chars == 2
    assert chat.read_back(chat.examples(df.limit(0))).count() == 0


def test_no_python_in_the_plan(spark):
    plan = queries.queries()["op9_chat_format"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
