from __future__ import annotations

import hashlib

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from demandpanel.llm import chat_format as cf

KIND = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "<|turn|>user<|says|>x<|done|>", "\\", "\\\\<|", "<\\|done|>", "a<\\\\|b", "[\\INST]", "<<SYS>>\n<</SYS>>", "", "é🙂\r\n\t", "<<|", "<s></s>"]


def rows():
    out = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(NASTY)]
    out += [(2, 0, "system", "be brief"), *((2, i, "user" if i % 2 else "assistant", f"t{i} " * (i * 13 % 60)) for i in range(1, 60))]
    out += [(3, i, "assistant" if i % 2 else "user", "w" * (7000 if i == 4 else i)) for i in range(9)]
    out += [(4, None, None, None), (4, 5, "assistant", "a"), (4, 5, "assistant", "a"), (4, 5, "user", "b"), (4, -1, "tool\n<|says|>", "r")]
    out += [(None, 0, "user", "null id"), (None, 1, "assistant", "yes")]
    out += [(5, i * 3, "assistant" if i % 2 else "user", f"turn {i} of many") for i in range(3000)]
    out += [(6, 0, "system", "s" * 3000), (6, 1, "user", "q"), (6, 2, "assistant", "z" * 900), (7, 0, "assistant", "")]
    return out


def test_digests_equal_the_turns_and_sql(spark):
    data = rows()
    out = cf.read_back(cf.windows(spark.createDataFrame(data, KIND).repartition(3))).toPandas()
    con = duckdb.connect()
    con.register("c", pd.DataFrame(data, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    sql = con.execute(cf.digest_sql("c")).df()
    key = lambda f: sorted(map(str, f[sorted(f.columns)].astype({"conv_id": "Int64", "n_turns": "Int64", "formatted_chars": "Int64"}).itertuples(index=False, name=None)))
    assert key(out) == key(sql)
    first = out[out.conv_id == 1].iloc[0]
    assert first.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for c, _, r, t in data if c == 1).encode()).hexdigest()
    assert first.loss_sha256 == hashlib.sha256("".join(NASTY[1::2]).encode()).hexdigest()


def test_windows_keep_to_the_budget_and_repeat_what_fits(spark):
    data = rows()
    out = cf.windows(spark.createDataFrame(data, KIND)).collect()
    tokens = lambda piece: -(-len(piece.split(cf.MIDDLE, 1)[1].encode()) // cf.BYTES) + cf.PER_TURN
    repeated = 0
    for r in out:
        pieces = r["text"].split(cf.END)[:-1]
        new = pieces[r["n_repeated"]:]
        assert new
        if r["conv_id"] in (2, 5):
            assert sum(map(tokens, pieces)) <= cf.BUDGET
            if r["conv_id"] == 2:
                assert pieces[0].startswith(cf.START + "system")
        if len(new) > 1:
            assert sum(map(tokens, new)) <= 2 * cf.quantum()
        repeated += r["n_repeated"]
        spans = [r["text"][s["start"]:s["start"] + s["length"]] for s in r["loss"]]
        assert spans == [p.split(cf.MIDDLE, 1)[1] for p in new if p.startswith(cf.START + "assistant" + cf.MIDDLE)]
    assert repeated > 50


def test_no_control_string_survives_in_texts_and_escapes_undo(spark):
    frame = spark.createDataFrame([(t + u,) for t in NASTY for u in NASTY], "t string")
    for t, e, back in frame.select("t", cf.escaped(F.col("t")), cf.unescaped(cf.escaped(F.col("t")))).collect():
        assert back == t and not any(c in e for c in cf.CONTROL)


def test_empty_table_and_extra_columns(spark):
    assert cf.windows(spark.createDataFrame([], KIND)).collect() == []
    assert cf.read_back(cf.windows(spark.createDataFrame([], KIND))).collect() == []
    more = spark.createDataFrame([(1, 0, "assistant", "a")], KIND).withColumns({"window": F.lit(1), "tokens": F.lit("x"), "conv": F.lit(2)})
    assert cf.windows(more).select("text").first()[0] == f"{cf.START}assistant{cf.MIDDLE}a{cf.END}"
