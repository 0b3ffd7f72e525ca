import hashlib

import pytest

from clickloom.operators import bloom
from clickloom.schemas import BLOOM_SALTS
from clickloom.session import scratch_path
from clickloom.sources import filters


def offsets(value, bits):
    return [int(hashlib.sha256((s + value).encode()).hexdigest(), 16) % bits for s in BLOOM_SALTS]


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "short_token string")


@pytest.mark.parametrize("bits,broadcast", [(20_000, True), (70_001, True), (1_000_000, True), (1_000_000, False)])
def test_probe_equals_set(spark, monkeypatch, bits, broadcast):
    if not broadcast:
        monkeypatch.setattr(bloom, "BROADCAST_BYTES", 0)
    # Few members leave some buckets of the large filter absent.
    members, asked = [f"m{i}" for i in range(8 if bits == 1_000_000 else 2_000)], [f"m{i}" for i in range(4_000)]
    on = {o for m in members for o in offsets(m, bits)}
    want = {a for a in asked if all(o in on for o in offsets(a, bits))}
    filter_ = bloom.build(frame(spark, members), bits)
    got = {r.short_token for r in bloom.probe(frame(spark, asked), filter_).collect() if r.maybe}
    assert got == want and set(members) <= got
    assert bloom.set_bits(filter_).first().bits_set == len(on)


def test_merge_is_union(spark):
    a, b = [f"a{i}" for i in range(50)], [f"b{i}" for i in range(50)]
    merged = bloom.merge(bloom.build(frame(spark, a)), bloom.build(frame(spark, b)))
    whole = bloom.build(frame(spark, a + b))
    rows = lambda f: {(r.bucket, bytes(r.bits)) for r in f.collect()}
    assert rows(merged) == rows(whole)


def test_first_and_last_bit(spark):
    values = [f"v{i}" for i in range(30)]
    on = {o for v in values for o in offsets(v, 3)}
    assert on == {0, 1, 2}
    assert bloom.set_bits(bloom.build(frame(spark, values), 3)).first().bits_set == 3


def test_size_is_kept_with_the_filter(spark):
    members = frame(spark, [f"m{i}" for i in range(50)])
    small, large = bloom.build(members, 4_000), bloom.build(members)
    assert (bloom.size_of(small), bloom.size_of(large)) == (4_000, 1_000_000)
    assert bloom.probe(members, small).filter("maybe").count() == 50
    with pytest.raises(ValueError, match="merged"):
        bloom.merge(small, large)
    with pytest.raises(ValueError, match="different"):
        bloom.probe(members, small.union(large))
    assert bloom.probe(members, small.limit(0)).filter("maybe").count() == 0


def test_size_for_a_rate():
    assert bloom.bits_for(1) == bloom.BUCKET_BITS
    bits = bloom.bits_for(100_000, 0.01)
    assert abs((1 - 2.718281828 ** (-3 * 100_000 / bits)) ** 3 - 0.01) < 0.0005


def test_stored_filter_grows_and_survives_replays(spark):
    """Ten times the planned tokens, each batch run twice: none is lost, and the rate of false positives holds."""
    path, capacity, rate = scratch_path(spark, "filter"), 200, 0.02
    tokens = lambda lo, hi: spark.range(lo, hi).selectExpr("concat('t', id) as short_token")
    edges = [0, 150, 200, 201, 700, 2_000]
    for batch_id, (lo, hi) in enumerate(zip(edges, edges[1:])):
        for _ in range(2):
            more = tokens(lo, hi).union(tokens(0, 50)).union(spark.createDataFrame([(None,)], "short_token string"))
            filters.add_tokens(spark, path, batch_id, more, capacity, rate)
    before = sorted(map(str, filters.read_filter(spark, path).collect()))
    assert len({r.layer for r in filters.read_filter(spark, path).select("layer").collect()}) > 2
    for upto in (1, 1, 3):
        filters.compact_filter(spark, path, upto)
        assert sorted(map(str, filters.read_filter(spark, path).collect())) == before
    with pytest.raises(ValueError):
        filters.add_tokens(spark, path, 2, tokens(0, 1), capacity, rate)
    probed = filters.probe_layers(tokens(0, 12_000).union(spark.createDataFrame([(None,)], "short_token string")), filters.read_filter(spark, path)).collect()
    assert len(probed) == 12_001
    maybe = {r.short_token: r.maybe for r in probed}
    assert all(maybe[f"t{i}"] for i in range(2_000)) and not maybe[None]
    assert sum(maybe[f"t{i}"] for i in range(2_000, 12_000)) <= 1.3 * rate * 10_000


def test_empty_stored_filter(spark):
    path = scratch_path(spark, "filter")
    nothing = spark.createDataFrame([], "short_token string")
    filters.add_tokens(spark, path, 0, nothing, 10)
    one = spark.createDataFrame([("a",)], "short_token string")
    assert [r.maybe for r in filters.probe_layers(one, filters.read_filter(spark, path)).collect()] == [False]
    with pytest.raises(ValueError):
        filters.add_tokens(spark, path, 3, one, 10)
