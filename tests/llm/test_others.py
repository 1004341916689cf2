"""Operators 4, 5, 7, 8, 9 and 10 and the pipeline, against brute force, round trips and held-out accuracy."""

import base64
import hashlib
import io
import itertools
import json
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import audio, bpe, mixing, quality, resharding, warc
from corpusloom.llm.common import table

SMALL = "/root/testdata/sf0.01"


def body(text):
    return (text or "").encode()


# quality


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in quality.query(spark, SMALL).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    held = [i for i in labels if rows[i].held_out]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in rows)
    assert sum(rows[i].predicted == labels[i] for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def test_scores_are_sums_of_table_cells():
    """Model.score and one round of boosting against loops over rows, bins and cuts."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    model = quality.fit(x, y, bins=6, rounds=3, pair_rounds=2, pairs_kept=2)
    for row, got in zip(x[:50], model.score(x[:50]), strict=True):
        cells = [sum(c <= v for c in cuts) for v, cuts in zip(row, model.cuts, strict=True)]
        total = model.base + sum(t[c] for t, c in zip(model.single, cells, strict=True)) + sum(t[cells[i], cells[j]] for (i, j), t in model.double.items())
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-12
    # a tree of two leaves: the cut of the greatest gain, and each side's step
    g, h, ridge = rng.normal(size=7), rng.uniform(0.1, 1, 7), 2.0
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + ridge)
    cut = max(range(1, 7), key=lambda k: gain(0, k) + gain(k, 7))
    want = [g[:cut].sum() / (h[:cut].sum() + ridge)] * cut + [g[cut:].sum() / (h[cut:].sum() + ridge)] * (7 - cut)
    assert np.allclose(quality._tree(g, h, 2, ridge), want)
    g, h = rng.normal(size=(4, 5)), rng.uniform(0.1, 1, (4, 5))
    best = max(((i, j) for i in range(1, 4) for j in range(1, 5)), key=lambda c: sum(p[0].sum() ** 2 / (p[1].sum() + ridge) for p in quarters(g, h, *c)))
    step, _ = quality._pair_tree(g, h, ridge)
    want = np.empty((4, 5))
    for part, (a, b) in zip(quarters(want, want, *best), quarters(g, h, *best), strict=True):
        part[0][:] = a.sum() / (b.sum() + ridge)
    assert np.allclose(step, want)


def quarters(g, h, i, j):
    return [(g[a, b], h[a, b]) for a in (slice(0, i), slice(i, None)) for b in (slice(0, j), slice(j, None))]


def test_no_feature_stops_at_a_prefix():
    """What stands behind the first hundred thousand bytes changes features, the count of the top word among them."""
    words = [f"word{k}" for k in range(20_000)]
    one, two = quality.features(" ".join(words).encode()), quality.features(" ".join([*words, *["again"] * 5000]).encode())
    top = quality.FEATURES.index("top_word")
    assert one[top] == 1 / 20_000 and two[top] == 5000 / 25_000


def test_quality_of_odd_rows(spark, edge_docs, edge_rows, no_docs):
    marks = spark.createDataFrame([(1, 1), (1, 0), (15, 0), (8, 1), (9, 1), (5, None)], "doc_id long, quality int")
    found = quality.featured(edge_docs)
    got = quality.scored(found, quality.train(found, marks)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in edge_rows) and all(0 <= r.score <= 1 for r in got)
    none = quality.train(found, marks.where("quality = 9"))
    assert {r.score for r in quality.scored(found, none).collect()} == {0.5}
    assert quality.scored(quality.featured(no_docs), none).count() == 0
    kept = quality.keep_good(edge_docs, none)
    assert kept.schema == edge_docs.schema and kept.count() == len(edge_rows)


def test_top_word_is_of_the_whole_text():
    top = lambda words: quality.features(" ".join(words).encode())[quality.FEATURES.index("top_word")]
    clean = [f"w{k}" for k in range(600)]
    assert top(clean) == 1 / 600 and top([]) == 0
    assert top(clean + ["again"] * 3000) == 3000 / 3600, "words behind the 400th count"
    assert top(clean[:50] + ["late"] * 50 + clean[:5]) == 50 / 105, "a word that isn't among the first 40 counts"


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, len(quality.FEATURES)))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.double and ((model.score(x) > 0.5) == y).mean() > 0.9


# WARC


def pages(spark):
    rows = [(1, "http://a/1", "<p>one"), (2, "http://a/2", "<p>one"), (3, "http://a/3\r\nX: y", None), (4, None, ""), (5, "http://b", "é" * 50_000), (6, "http://b", "only"), (6, "http://b", "only"), (7, "http://c", "only"), (7, "http://c", "only"), (None, "http://d", "<p>one"), (-5, "http://e", "\r\n\r\nWARC/1.1\r\n")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_read_back(spark, tmp_path):
    rows, df = pages(spark)
    folder = f"file://{tmp_path}/w"
    df = df.withColumns({n: F.lit("extra") for n in ("payload", "same", "refers_to", "n", "file", "records", "payload_bytes", "payload_digest", "record_type")})
    got = Counter(tuple(r) for r in warc.read_archives(warc.write_archives(df, folder), folder).collect())
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    want = Counter()
    for i, _, h in rows:
        kept = best[h or ""]
        same = i is None or i == kept
        want[i, len(body(h)), base64.b32encode(hashlib.sha1(body(h)).digest()).decode(), "response" if same else "revisit", None if same else kept] += 1
    assert got == want
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(empty, folder), folder).count() == 0


def test_record_ids_hold_page_ids():
    assert all(warc.page_of(warc.record_id(i)) == i for i in (0, 1, -1, 2**63 - 1, -(2**63), None))


def test_archive_starts_with_its_dictionary(tmp_path):
    samples = [warc.record(i, f"http://x/{i}", f"<html><head><title>{i}</title></head><body>{'words ' * (i % 9)}</body></html>".encode(), None) for i in range(300)]
    dictionary = warc.train(samples, 4096)
    (name, count), *rest = warc.Writer(f"file://{tmp_path}", dictionary).write(samples)
    data = (tmp_path / name).read_bytes()
    assert not rest and count == 300 and data[:4] == bytes.fromhex("5d2a4d18") and data[8 : 8 + len(dictionary)] == dictionary
    assert [warc.parsed(h, b)[0] for h, b in warc.read(io.BytesIO(data))] == list(range(300))
    with pytest.raises(ValueError):
        list(warc.read(io.BytesIO(data[:-30]), 300))
    assert len(list(warc.Writer(f"file://{tmp_path}", dictionary, roll=2000).write(samples))) > 1


# resharding


def test_flow_moves_the_fewest_bytes():
    flows = resharding.min_cost_flow([50, 10, 0], [20, 20, 10, 10], lambda i, j: 0 if i == j else 1)
    assert sum(sum(f.values()) for f in flows) == 60 and flows[0][0] == 20 and flows[1][1] == 10
    assert sum(n for i, f in enumerate(flows) for j, n in f.items() if i != j) == 30
    dear = resharding.min_cost_flow([10, 10], [0, 10, 10], lambda i, j: [[0, 1, 5], [1, 0, 2]][i][j])
    assert dear == [{1: 10}, {2: 10}]


def test_no_transfer_moves_fewer_bytes():
    def ways(supply, room):  # every whole-number transport
        if not supply:
            yield ()
            return
        for row in itertools.product(*(range(min(supply[0], r) + 1) for r in room)):
            if sum(row) == supply[0]:
                for rest in ways(supply[1:], [r - x for r, x in zip(room, row, strict=True)]):
                    yield (row, *rest)

    rng = np.random.default_rng(4)
    for _ in range(25):
        supply = rng.integers(0, 5, 3).tolist()
        room = resharding.capacities(sum(supply), int(rng.integers(2, 5)))
        price = rng.integers(0, 4, (3, len(room))).tolist()
        flows = resharding.min_cost_flow(supply, room, lambda i, j: price[i][j])
        assert [sum(f.values()) for f in flows] == supply
        cost = sum(n * price[i][j] for i, f in enumerate(flows) for j, n in f.items())
        assert cost == min(sum(n * price[i][j] for i, row in enumerate(w) for j, n in enumerate(row)) for w in ways(supply, room))


def test_resharding(spark, edge_docs, edge_rows, no_docs, tmp_path):
    layout = resharding.Layout(old=3, new=4, blocks=4, cells=4)
    got = resharding.reshard(edge_docs, layout, f"file://{tmp_path}/one").collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len(body(r[1])) + 8, zlib.crc32(body(r[1]))) for r in edge_rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    assert resharding.reshard(no_docs).count() == 0


def test_old_shards_are_files_that_growth_leaves_alone(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    layout = resharding.Layout(old=4, new=6, blocks=8, cells=16)
    old = resharding.write_old(docs, layout, f"file://{tmp_path}/a").select("doc_id", "block").collect()
    more = resharding.write_old(docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**6)), layout, f"file://{tmp_path}/b")
    assert set(old) <= set(more.select("doc_id", "block").collect())


def test_affected_files_are_rewritten_and_the_fewest_bytes_move(spark, tmp_path):
    docs, layout, path = table(spark, SMALL, "documents"), resharding.Layout(old=4, new=6, blocks=8, cells=16), f"file://{tmp_path}/c"
    got = resharding.reshard(docs, layout, path).collect()
    old = spark.read.parquet(f"{path}/old")
    supply = {r.shard: r.n for r in old.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    room = resharding.capacities(sum(supply.values()), 6)
    least = sum(max(0, supply.get(i, 0) - room[i]) for i in range(4))
    largest = max(r.size for r in got)
    assert least <= sum(r.size for r in got if r.moved) + largest * 4 and sum(r.size for r in got if r.moved) <= least + largest * 10
    stay = resharding.planned(old, layout).stay
    new = spark.read.parquet(f"{path}/new")
    # the new layout on disk is the whole corpus: blocks left alone, and all rows of the others, those that stay in their shard too
    assert old.where(F.col("block").isin(stay)).count() + new.count() == docs.count() and new.where("shard = old_shard").count() > 0
    assert stay and not set(stay) & {r.block for r in new.select("block").distinct().collect()}


def test_shards_are_near_equal(spark):
    rows = resharding.query(spark, SMALL).collect()
    size = Counter()
    for r in rows:
        size[r.shard] += r.size
    mean = sum(size.values()) / 24
    assert len(size) == 24 and max(size.values()) - min(size.values()) < 0.05 * mean


# byte-level BPE


@pytest.fixture(scope="module")
def encoders():
    import tiktoken

    path, pattern = bpe.production()
    ranks = bpe.load_ranks(path)
    return bpe.Encoder(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_encoding_is_the_library_s(encoders):
    own, library = encoders
    rng = np.random.default_rng(1)
    parts = ["a", "b", "e", "the", " ", "\n", "  ", "é", "日本", "🎉", "́", "12", "34", "'s", "'", "!", "==", "\t", "ing", "tion", "\x00", "ZZ", "\x1c", "\x85", " ", "½", "٣", "ǅ", "ª", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rng.choice(parts, rng.integers(0, 50)))
        assert own.encode(text) == library.encode_ordinary(text)
    for text in ("a" * 5000, "the" * 2000, " " * 3000, "=-" * 1000, "".join(rng.choice(list("abcdefgh"), 4000))):
        assert own.encode(text) == library.encode_ordinary(text)


def test_every_piece_goes_through_the_moves(encoders):
    own, _ = encoders
    rng = np.random.default_rng(2)
    tokens = list(own.fst.tokens.values())
    for _ in range(1500):
        piece = b"".join(tokens[k] for k in rng.integers(0, len(tokens), rng.integers(1, 4)))[:60]
        assert own.fst.encode(piece) == list(bpe.merge(piece, own.fst.ranks))
    fresh = bpe.Encoder(own.fst.ranks, bpe.production()[1])
    fresh.encode("a short text")
    state, seen = 0, 0
    for byte in b" short":  # each byte of each piece has a move from the state before
        state, _ = fresh.fst.moves[state << 8 | byte]
        seen += 1
    assert seen == 6 and len(fresh.fst.moves) >= len("a short text") - 2


def test_a_worker_keeps_its_encoder():
    ranks = {bytes((i,)): i for i in range(256)}
    one = bpe.worker_encoder("x", ranks, ".")
    assert bpe.worker_encoder("x", ranks, ".") is one and bpe.worker_encoder("y", ranks, ".") is not one
    bpe.release(0.05)
    two = bpe.worker_encoder("y", ranks, ".")  # in time: the timer is off
    time.sleep(0.2)
    assert bpe.worker_encoder("y", ranks, ".") is two
    bpe.release(0.05)
    time.sleep(0.2)
    assert bpe.worker_encoder("y", ranks, ".") is not two


def test_small_caches_change_nothing(encoders):
    own, _ = encoders
    tiny = bpe.Encoder(own.fst.ranks, bpe.production()[1], words=3)
    tiny.fst.most = 10
    text = "some words, some more words and 12345 numbers\n\n  and so on " * 5 + "x" * 300
    assert tiny.encode(text) == own.encode(text)


def test_decoding_holds_back_unfinished_characters():
    text = "aé日🎉" * 3
    state, out = bpe.Utf8(), []
    for byte in text.encode():
        part = state.feed(bytes([byte]))
        part.decode()
        out.append(part)
    assert b"".join(out) + state.end() == text.encode()
    broken = b"\xff\xc3(\xe6\x97"
    state = bpe.Utf8()
    assert b"".join(state.feed(bytes([b])) for b in broken) + state.end() == broken


def test_encoded_documents(edge_docs, edge_rows, no_docs, encoders):
    _, library = encoders
    want = Counter()
    for r in edge_rows:
        ids = library.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(body(r[1])).hexdigest(), tuple(ids)] += 1
    got = bpe.encode_documents(edge_docs, *bpe.production(), with_ids=True).collect()
    assert Counter((*r[:4], tuple(r.ids)) for r in got) == want
    assert bpe.encode_documents(no_docs, *bpe.production()).count() == 0


# audio


@pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 3), (3, 2), (5, 8), (1, 1)])
def test_polyphase_equals_stuffing_and_filtering(up, down):
    x = np.random.default_rng(0).normal(size=500).astype(np.float32)
    kernel, stuffed = audio.lowpass(up, down), np.zeros(500 * up, np.float32)
    stuffed[::up] = x
    want = np.convolve(stuffed, kernel)[len(kernel) // 2 :][: len(stuffed)][::down]
    assert np.allclose(audio.resample(x, up, down), want, atol=1e-4)


def test_segments_have_hysteresis():
    energy = np.array([-60, -11, -15, -17, -11, -19, -15, -13, -5, 0, -30.0])
    assert audio.segments(energy) == [(1, 5), (8, 10)]


def test_log_mels_equal_a_plain_transform():
    y, rate = np.random.default_rng(5).normal(size=700).astype(np.float32), 8000
    mel, energy = audio.log_mels(y, rate)
    mels = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, mels(rate / 2), audio.MELS + 2)]
    for f in range(len(mel)):
        frame = y[f * audio.HOP : f * audio.HOP + audio.FRAME].astype(float)
        assert abs(energy[f] - 10 * np.log10((frame**2).mean() + 1e-10)) < 1e-6
        smooth = frame * [0.5 - 0.5 * np.cos(2 * np.pi * t / audio.FRAME) for t in range(audio.FRAME)]
        power = [abs(sum(v * np.exp(-2j * np.pi * k * t / audio.FRAME) for t, v in enumerate(smooth))) ** 2 for k in range(audio.FRAME // 2 + 1)]
        for m in range(audio.MELS):
            low, top, high = edges[m : m + 3]
            total = 0.0
            for k, p in enumerate(power):
                hz = k * rate / audio.FRAME
                total += p * max(0.0, min((hz - low) / (top - low), (high - hz) / (high - top)))
            assert abs(mel[f, m] - np.log(total + 1e-6)) < 1e-3


def test_audio(edge_docs, edge_rows, no_docs, tmp_path):
    import wave

    stored = audio.store(edge_docs)
    rows = audio.featured(stored).collect()
    media = {hashlib.sha256(bytes(r.media)).hexdigest(): bytes(r.media) for r in stored.collect()}
    want = Counter()
    for r in edge_rows:
        text = body(r[1])
        padded = text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))
        want[r[0], len(text), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
    assert Counter(tuple(r[:5]) for r in rows) == want
    for r in rows:
        with wave.open(io.BytesIO(media[r.media_sha256])) as f:
            assert f.getsampwidth() == 1 and hashlib.sha256(f.readframes(f.getnframes())).hexdigest() == r.payload_sha256
    features = defaultdict(set)
    for r in rows:
        features[r.payload_sha256].add((r.feature, str(r.spans)))
    assert all(len(f) == 1 for f in features.values())
    import pyarrow as pa

    path = f"file://{tmp_path}/features"
    audio.featured(stored).write.parquet(path)
    metadata = edge_docs.sparkSession.read.parquet(path).schema["patches"].metadata  # the column keeps its tensor type in Parquet
    tensors = audio.tensors(pa.array([r.patches for r in rows], pa.list_(pa.float32())), metadata)
    assert tensors.type.shape == list(audio.SHAPE) and len(tensors) == sum(len(r.patches) for r in rows) // (audio.PATCH * audio.MELS)
    assert audio.featured(audio.store(no_docs)).count() == 0


# mixing


def test_mixing_equals_sql(spark, edge_docs, edge_rows, no_docs):
    for plan in (mixing.Mixture(), mixing.Mixture(share=0.9, epochs=1), mixing.Mixture(share=1.7, epochs=3, digits=1)):
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", edge_rows)
        want = Counter(con.execute(mixing.oracle(plan)).fetchall())
        got = mixing.mix(edge_docs, plan)
        assert Counter((r.row_.doc_id, r.domain, r.language, r.source, r.tokens, r.quota, r.copies) for r in got.collect()) == want
        rows = mixing.mixed_rows(edge_docs, plan)
        assert rows.columns == edge_docs.columns and rows.count() == sum(n * k[-1] for k, n in want.items())
    assert mixing.mix(no_docs).count() == 0


def test_many_leaves_are_joined_by_salts(edge_docs, monkeypatch):
    want = Counter(str(r) for r in mixing.mix(edge_docs).drop("row_").collect())
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    assert Counter(str(r) for r in mixing.mix(edge_docs).drop("row_").collect()) == want


def test_shortages_go_to_siblings_first(spark):
    rows = [(i, "x" * 400, "en", "s1") for i in range(2)] + [(10 + i, "x" * 400, "en", "s2") for i in range(50)] + [(100 + i, "x" * 400, "de", "s3") for i in range(50)]
    plan = mixing.Mixture(share=0.5, epochs=1, weights={"domain": {}, "language": {}, "source": {}})
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    quota = {r.source: r.quota for r in mixing.quotas(mixing.labelled(docs, plan).withColumn("domain", F.lit("d")), plan).collect()}
    assert quota == {"s1": 200, "s2": 2350, "s3": 2550}


def test_domains_are_the_caller_s(spark):
    docs = spark.createDataFrame([(i, "x" * 400, "en", f"s{i % 3}") for i in range(90)], "doc_id long, text string, lang string, source string")
    plan = mixing.Mixture(share=0.5, epochs=1, domains={"s0": "law", "s1": "news"}, weights={"domain": {"law": 3, "news": 1, "": 1}, "language": {}, "source": {}})
    tokens = Counter()
    for r in mixing.mix(docs, plan).collect():
        tokens[r.domain] += r.tokens * r.copies
    assert tokens == {"law": 2700, "news": 900, "": 900}


@pytest.mark.parametrize(("digits", "steps"), [(1, 0), (1, 1), (1, 4), (3, 1)])
def test_steps_of_ranges_change_nothing(edge_docs, digits, steps):
    want = Counter(str(r) for r in mixing.mix(edge_docs).drop("row_").collect())
    assert Counter(str(r) for r in mixing.mix(edge_docs, mixing.Mixture(digits=digits, steps=steps)).drop("row_").collect()) == want


# pipeline


def test_stages_of_odd_rows(spark, edge_docs, edge_rows, no_docs):
    """Nulls, empty and very long texts, ties, repeats and clashing names: each stage keeps the columns, and an empty table stays empty."""
    import corpus_pipeline

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    assert labels.count() > 0
    ids = {r[0] for r in edge_rows}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got, none = stage(spark, edge_docs, SMALL), stage(spark, no_docs, SMALL)
        assert none.count() == 0 and {r.doc_id for r in got.select("doc_id").collect()} <= ids
        if k < 4:
            assert got.columns == edge_docs.columns and none.columns == no_docs.columns
        else:
            assert got.count() == len(edge_rows)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    now, counts = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, SMALL).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == docs.columns
        counts.append(after.count())
        now = after
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    first = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/0").select("doc_id").collect()}
    assert sum(q == 1 and i in first for i, q in labels.items()) / sum(labels.values()) > 0.98
    assert sum(q == 0 and i not in first for i, q in labels.items()) / sum(q == 0 for q in labels.values()) > 0.9
    assert 0 < counts[4] == counts[3] <= 2 * counts[2] and counts[2] <= counts[1] <= counts[0] < 1000
    run = corpus_pipeline.run(spark, SMALL)
    key = lambda df: Counter(tuple(r) for r in df.select("doc_id", "ids_sha256").collect())
    assert key(run) == key(now)
    assert json.dumps(run.first().ids)
