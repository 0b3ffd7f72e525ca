"""Mixing, archive, chat formatting and nearest neighbours: contracts, round trips and odd rows."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import chat, cross_polytope, mixing, warc
from clickloom.session import scratch_path


def _mix_rows():
    out = []
    for s, source in enumerate(["b", "a", "é", None, "z"]):
        for i in range(60 + 3 * s if s else 200):
            out.append((len(out), " ".join(["w"] * ((i * 7 + s) % 40 + (500 if i == 3 else 0))), source))
    return [*out, (None, None, "a"), (5, "w w", "b"), (5, "w w", "b"), (9000, "", "lonely"), (9001, None, "lonely")]


def test_mixing(spark):
    rows = _mix_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as size", "2 as copies", "3 as words", "4 as n")
    found = mixing.mix(docs)
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), 1.5 * sum(size.values())
    while True:
        rest = total - sum(2 * size[s] for s in capped)
        level = rest / sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and level * weight[s] > 2 * size[s]}
        if not new:
            break
        capped |= new
    target = {s: 2.0 * size[s] if s in capped else level * weight[s] for s in order}
    by_source = {}
    rows_out = found.toPandas()
    assert len(rows_out) == len(rows)
    for s in order:
        mine = rows_out[(rows_out.source_size == size[s]) & np.isclose(rows_out.target, target[s])]
        by_source[s] = int(mine.taken.sum())
        assert abs(by_source[s] - target[s]) <= max(2, 0.005 * target[s])
    assert (rows_out.taken <= 2 * rows_out["size"]).all()
    assert set(rows_out.copies) <= {0, 1, 2}


def test_mixing_tilts(spark):
    """Within a source the odds of being taken follow the size: rates solve the entropy dual."""
    rows = [(i, " ".join(["w"] * (10 if i % 2 else 30)), "abc"[i % 3]) for i in range(3000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).toPandas()
    found["source"] = [("abc")[i % 3] for i in found.doc_id]
    for _, group in found.groupby("source"):
        rates = group.groupby("size").copies.mean()
        if 0 < rates.min() and rates.max() < 2:
            odds = {s: math.log(r / (2 - r)) for s, r in rates.items()}
            assert odds[30] == pytest.approx(3 * odds[10], abs=0.05)


def test_mixing_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0


def _pages():
    same = "<p>Grüße\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(7, "http://a/ b", same), (3, None, same), (9, "u", same), (4, "u", None), (5, "u", ""), (6, "http://é", "x"), (8, "v", "y" * 100_000), (10, "v", "x\r\n\r\n")]
    return [*rows, (10, "v", "x\r\n\r\n"), (None, "n", "z")]


@pytest.mark.parametrize("least", [0, 2])
def test_warc_round_trip(spark, least):
    pages = spark.createDataFrame(_pages(), "page_id bigint, url string, html string").selectExpr("*", "1 as payload", "2 as digest", "3 as size", "4 as first")
    path = scratch_path(spark, "warc")
    import base64
    import hashlib
    from collections import Counter

    found = warc.archive(pages, path, least).collect()
    raw = [(p, (h or "").encode()) for p, _, h in _pages()]
    firsts = {}
    for p, body in raw:
        firsts[body] = min((q for q, other in raw if other == body and q is not None), default=None)
    expected, opened = Counter(), set()
    for p, body in sorted(raw, key=lambda r: (r[0] is None, r[0] or 0)):
        kind, first = "response", None
        if len(body) >= least and body in opened:
            kind, first = "revisit", firsts[body]
        opened.add(body)
        expected[p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, first] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == expected
    restored = warc.restore(warc.read(spark, path)).collect()
    assert Counter((r.page_id, bytes(r.payload)) for r in restored) == Counter(raw)
    assert all(bytes(r.header).startswith(b"WARC/1.1\r\nWARC-Type: ") for r in restored)
    assert len({bytes(r.header).split(b"\r\n")[2] for r in restored}) == len(raw)


def test_warc_stores_a_repeated_payload_once(spark):
    """A row that is a third of the table, and as many rows without id, add headers only."""
    pages = spark.range(600).selectExpr("if(id % 3 = 0, 1, if(id % 3 = 1, null, id)) as page_id", "if(id % 3 = 1, null, 'u') as url", "if(id % 3 = 2, concat('x', id), repeat('y', 20000)) as html")
    path = scratch_path(spark, "warc")
    kinds = warc.archive(pages, path).filter("payload_bytes > 100").groupBy("record_type").count().collect()
    assert dict(map(tuple, kinds)) == {"response": 1, "revisit": 399}
    stored = warc.read(spark, path).filter("payload is not null").selectExpr("sum(length(payload)) as n").first().n
    assert stored < 20_000 + 200 * 10


def test_warc_finds_damage(spark):
    import gzip
    from pathlib import Path

    pages = spark.createDataFrame([(1, "u", "abc")], "page_id bigint, url string, html string")
    path = scratch_path(spark, "warc")
    warc.write(pages, warc.records(pages), path)
    for file in Path(path).glob("part-*"):
        data = gzip.decompress(file.read_bytes())
        file.write_bytes(gzip.compress(data.replace(b"abc", b"abd")))
        file.with_name(f".{file.name}.crc").unlink()
    with pytest.raises(Exception, match="not the one"):
        warc.read(spark, path).collect()


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archive(pages, scratch_path(spark, "warc")).count() == 0


ODD = ["a\\b<|x|>[INST]", "z\n\\", "</s><s>[/INST] <<SYS>>", "", "é日本<|im_end|>\n<|im_start|>user\nhi", "\\<|", "<\\|", "\\\\", "<<|||>"]


def test_chat_escape_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for t, e, back in df.withColumn("b", chat.unescape(F.col("e"))).collect():
        assert back == t
        assert not any(plain in e for plain, _ in chat.ESCAPES[1:])


def test_chat_layouts(spark):
    records = {
        1: ({"messages": [{"role": "user", "content": ODD[0]}, {"content": ODD[1], "role": "assistant"}]}, "messages", [("user", ODD[0]), ("assistant", ODD[1])]),
        2: ({"completion": ODD[2], "prompt": ODD[4]}, "prompt", [("user", ODD[4]), ("assistant", ODD[2])]),
        3: ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": None}]}, "conversations", [("user", "h"), ("assistant", "")]),
        4: ({"instruction": "i", "input": "", "output": "o"}, "instruction_input", [("user", "i"), ("user", ""), ("assistant", "o")]),
        5: ({"turns": [{"role": "a\n\\b", "text": "t"}]}, "turns", [("a\n\\b", "t")]),
        6: ({"system": "s", "prompt": "p", "response": ODD[5]}, "system_prompt", [("system", "s"), ("user", "p"), ("assistant", ODD[5])]),
    }
    raw = [(i, json.dumps(r[0])) for i, r in records.items()] + [(7, json.dumps({"foo": {"bar": 1}})), (8, None), (9, "{bad"), (10, "[]"), (11, json.dumps({"messages": []}))]
    found = chat.canonical(spark.createDataFrame(raw, "conv_id bigint, record string"))
    got = {r["conv_id"]: r for r in found.collect()}
    back = {r["conv_id"]: r for r in chat.read_back(chat.render(found.filter("turns is not null"))).collect()}
    for i, (_, layout, turns) in records.items():
        assert got[i]["layout"] == layout
        assert [tuple(t) for t in back[i]["turns"]] == turns
        assert back[i]["learned"] == [t for r, t in turns if r == "assistant"]
    assert all(got[i]["layout"] is None for i in (7, 8, 9, 10, 11))


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (1, 2, "assistant", "x"), (1, 2, "assistant", "x"), (None, 0, "user", "lost"), (2, None, None, "t")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as items", "2 as record")
    found = {r["conv_id"]: r for r in chat.formatted_digests(chat.records(df)).collect()}
    assert (found[1]["n_turns"], found[1]["loss_chars"], found[2]["n_turns"]) == (4, 2, 1)
    assert (found[None]["n_turns"], len(found)) == (1, 3)
    assert chat.formatted_digests(chat.records(df.limit(0))).count() == 0


def test_chat_large_conversation(spark):
    """Many turns, and a text of more characters than a JSON reader takes, go the same way as all others."""
    rows = [(1, i, ["user", "assistant"][i % 2], ODD[i % len(ODD)]) for i in range(2500)] + [(2, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert sorted((r["conv_id"], r["n_turns"]) for r in chat.formatted_digests(chat.records(df)).collect()) == [(1, 2500), (2, 1)]
    whole = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    whole = whole.select("conv_id", F.to_json(F.struct(F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))).alias("record"))
    assert sorted(map(tuple, chat.formatted_digests(whole).collect())) == sorted(map(tuple, chat.formatted_digests(chat.records(df)).collect()))
    long = df.filter("conv_id = 2").selectExpr("conv_id", "turn", "'assistant' as role", "repeat('x', 20000001) as text")
    assert [(r["n_turns"], r["loss_chars"]) for r in chat.formatted_digests(chat.records(long)).collect()] == [(1, 20000001)]


def test_chat_turns_come_from_the_record(spark):
    """What formatting gives follows from the records alone, however their texts look and however long they are."""
    texts = [*ODD, '", "role": "x', '{"messages": [{"role": "a", "content": "b"}]}', 'a": "b', "\\\\\"", "\\u0041\x01\t", '"' * 3, ' : "']
    df = spark.createDataFrame([(1, i, 'us"er:', t) for i, t in enumerate(texts)], "conv_id bigint, turn bigint, role string, text string")
    records = chat.records(df)
    assert records.columns == ["conv_id", "record"]
    found = chat.canonical(records, strict=True).first()
    assert (found["layout"], [tuple(t) for t in found["turns"]]) == ("messages", [('us"er:', t) for t in texts])
    assert json.loads(records.first()["record"])["messages"][9]["content"] == texts[9]
    other = records.withColumn("record", F.replace("record", F.lit('"content"'), F.lit('"text"')))
    assert chat.canonical(other).first()["layout"] is None
    unread = spark.createDataFrame([(1, '{"prompt": "a\x01", "completion": "b"}')], "conv_id bigint, record string")
    assert tuple(chat.canonical(unread).first()) == (1, None, None)
    long = spark.range(1).selectExpr("1 as conv_id", "0 as turn", "'assistant' as role", "concat(repeat('x', 20000001), '\\\\\"') as text")
    changed = chat.records(long).withColumn("record", F.replace("record", F.lit("assistant"), F.lit("user")))
    assert [r["loss_chars"] for r in chat.formatted_digests(chat.records(long)).union(chat.formatted_digests(changed)).collect()] == [20_000_003, 0]


def test_chat_unknown_layouts_are_kept(spark):
    raw = [(1, json.dumps({"prompt": "p", "completion": "c"})), (7, json.dumps({"foo": {"bar": 1}})), (8, None), (10, "[]"), (11, json.dumps({"messages": []}))]
    found = {r["conv_id"]: tuple(r)[1:] for r in chat.formatted_digests(spark.createDataFrame(raw, "conv_id bigint, record string")).collect()}
    assert found[1][0] == 2
    assert all(found[i] == (None,) * 5 for i in (7, 8, 10, 11))
    with pytest.raises(Exception, match="MALFORMED"):
        chat.formatted_digests(spark.createDataFrame([(9, "{bad")], "conv_id bigint, record string")).collect()


def test_nearest_small_and_odd(spark):
    rows = [(i, [float(i % 5), 1.0, 0.0]) for i in range(12)]
    rows += [(20, None), (21, []), (22, [0.0, 0.0, 0.0]), (23, [1.0, None, 2.0]), (24, [float("nan"), 1.0, 1.0]), (25, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 0.0]), (30, [1.0, 2.0]), (0, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as bucket", "2 as dims", "3 as block")
    found = cross_polytope.search(df, df.filter("vec_id in (0, 3, 20, 22, 24, 30)")).collect()
    good = {i: np.array(v) for i, v in rows[:12]}
    expected = []
    for q in (0, 3):
        near = sorted((math.sqrt(((good[q] - v) ** 2).sum()), i) for i, v in good.items() if i != q)[:10]
        expected += [(q, r + 1, i, s) for r, (s, i) in enumerate(near)]
    assert sorted(map(tuple, found)) == expected
    assert cross_polytope.search(df.limit(0), df.limit(0)).count() == 0


def test_hot_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)] + [(1000 + i, [float(i), 2.0, 3.0, 4.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = cross_polytope.search(df, df.filter("vec_id % 100 = 0")).collect()
    zero = sorted(r["vec_id"] for r in found if r["query_id"] == 200)
    assert zero == list(range(10))
    assert sorted(r["vec_id"] for r in found if r["query_id"] == 0) == list(range(1, 11))


def test_full_bucket_is_dealt_out(spark, monkeypatch):
    """Near copies of one vector share all buckets; no task gets them all, and the nearest are the same."""
    seen = spark.sparkContext.accumulator(0)
    rank = cross_polytope._rank

    def counted(k):
        inner = rank(k)

        def run(rows, asked):
            seen.add(int(len(rows) > 150))
            return inner(rows, asked)

        return run

    monkeypatch.setattr(cross_polytope, "_rank", counted)
    rng = np.random.default_rng(3)
    vectors = np.ones(8) + rng.normal(0, 1e-3, (400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    found = cross_polytope.search(df, df.filter("vec_id % 100 = 0"), block_rows=50).collect()
    assert seen.value == 0
    for query in (0, 100, 200, 300):
        apart = np.sqrt(((vectors - vectors[query]) ** 2).sum(axis=1))
        apart[query] = np.inf
        assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == query] == np.argsort(apart, kind="stable")[:10].tolist()
