"""Operators 1, 2, 3 and 6, and the pipeline's near-dedup, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from corpusloom.llm import exact_dedup, line_dedup, near_text, simhash, suffix_dedup
from corpusloom.llm.components import components

LAST = (1 << 63) - 1


def body(text):
    return (text or "").encode()


def spot(doc_id, text):
    return LAST if doc_id is None else doc_id, line_dedup.tie(body(text))


# exact dedup


def test_exact_dedup(edge_docs, edge_rows):
    norm = lambda t: re.sub(rb"[\x20\x09-\x0D]+", b" ", body(t))
    groups = defaultdict(list)
    for r in edge_rows:
        groups[norm(r[1])].append(r[0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    got = exact_dedup.exact_dedup(edge_docs).collect()
    assert len(got) == len(edge_rows)
    want = Counter((r[0], least[norm(r[1])], len(groups[norm(r[1])]), hashlib.sha256(norm(r[1])).hexdigest()) for r in edge_rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_of_nothing(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_cut_points_follow_content():
    rng = np.random.default_rng(0)
    text = rng.integers(32, 127, 60_000, dtype=np.uint8).tobytes()
    chunks = list(exact_dedup.chunks(text))
    assert b"".join(chunks) == text and max(map(len, chunks)) <= exact_dedup.MOST
    moved = set(exact_dedup.chunks(b"some bytes before" + text))
    assert len(moved & set(chunks)) > len(chunks) // 2


# line dedup


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_distance_and_keys():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        a, b = (rng.choice(np.frombuffer(b"ab", np.uint8), rng.integers(0, 9)).tobytes() for _ in range(2))
        for edits in range(4):
            assert line_dedup.within(a, b, edits) == (lev(a, b) <= edits)
        x, y = (a, b) if len(a) >= len(b) else (b, a)
        for edits in (1, 2, 3):
            if lev(a, b) <= edits < len(y):
                assert set(line_dedup.line_keys(x, edits)) & set(line_dedup.line_keys(y, edits)[: edits + 1])


@pytest.mark.parametrize("edits", [1, 2, 3])
@pytest.mark.parametrize("pieces", [1, 2, 4])
def test_fine_keys_are_shared_by_similar_lines(edits, pieces):
    rng = np.random.default_rng(edits * 10 + pieces)
    letters = list("abcé")
    for _ in range(250):
        y = "".join(rng.choice(letters, rng.integers(edits + 1, 30)))
        x = y
        for _ in range(rng.integers(0, edits + 1)):
            at = int(rng.integers(0, len(x) + 1))
            x = x[:at] + "".join(rng.choice(letters, rng.integers(0, 2))) + x[at + int(rng.integers(0, 2)) :]
        x, y = (x, y) if len(x) >= len(y) else (y, x)
        if lev(x, y) <= edits and len(y) > edits:
            (asked, _, one), (keys, own, two) = line_dedup.fine_keys(line_dedup.characters(x.encode()), edits, pieces), line_dedup.fine_keys(line_dedup.characters(y.encode()), edits, pieces)
            assert set(asked.tolist()) & set(keys[own].tolist()), (x, y)
            assert line_dedup.letters_allow(np.array([one]), np.array([two]), edits)[0]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_probes_find_an_untouched_segment(edits):
    rng = np.random.default_rng(edits)
    for _ in range(500):
        y = rng.integers(0, 3, rng.integers(edits + 1, 14)).astype(np.uint8).tobytes()
        x = bytearray(y)
        for _ in range(rng.integers(0, edits + 1)):
            at = int(rng.integers(0, len(x) + 1))
            x[at : at + int(rng.integers(0, 2))] = bytes(rng.integers(0, 3, rng.integers(0, 2)).astype(np.uint8))
        x, y = (bytes(x), y) if len(x) >= len(y) else (y, bytes(x))
        if lev(x, y) <= edits and len(y) > edits:
            own = line_dedup.segments(len(y), edits)
            assert any(x[at : at + n] == y[own[i][0] : own[i][0] + n] for i, at, n in line_dedup.probes(len(x), len(y), edits))


def brute_lines(rows, least):
    first = {}
    for s, text in sorted({(spot(r[0], r[1]), body(r[1])) for r in rows}):
        for k, line in enumerate(text.split(b"\n")):
            if line.strip():
                first.setdefault(line, (*s, k))
    long = [(x, x.decode()) for x in first if len(x.decode()) >= least]
    alike = lambda a, b: abs(len(a) - len(b)) <= line_dedup.EDITS and line_dedup.within(a, b)
    links = {tuple(sorted((first[a], first[b]))) for i, (a, x) in enumerate(long) for b, y in long[:i] if alike(x, y)}
    gone = {b for _, b in links}
    out = Counter()
    for r in rows:
        s = spot(r[0], r[1])
        out[r[0], b"\n".join(x for k, x in enumerate(body(r[1]).split(b"\n")) if not x.strip() or first[x] == (*s, k) and (*s, k) not in gone)] += 1
    return out, links


@pytest.mark.parametrize("hot", [line_dedup.HOT, 4])
def test_line_dedup(spark, edge_docs, edge_rows, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    want, links = brute_lines(edge_rows, line_dedup.LEAST)
    got = line_dedup.line_dedup(edge_docs).collect()
    assert Counter((r.doc_id, bytes(r.text)) for r in got) == want
    pairs = {((r.a_did, r.a_line), (r.b_did, r.b_line)) for r in line_dedup.line_links(edge_docs).collect()}
    assert links and pairs == {((a[0], a[2]), (b[0], b[2])) for a, b in links}
    ends = Counter((LAST if r.doc_id is None else r.doc_id, x.line) for r in {(r.did, r.tie): r for r in got}.values() for x in r.linked for _ in range(x.links))
    assert ends == Counter((x[0], x[2]) for pair in links for x in pair) and all(r.n_links == sum(x.links for x in r.linked) for r in got)


def test_documents_of_linked_lines_are_a_class(spark):
    line = lambda k, word: f"posted on day {k} by {word} of the whole list, read it all"
    rows = [(k, line(10 + k // 10 * 10 + k % 10, "someone") + f"\nown text number {k} {'abcdefghij'[k % 10] * 25}") for k in range(30)]
    rows += [(50, None), (51, "unlike everything else here " * 2), (None, "unlike everything else that is here " * 2 + "!"), (40, line(11, "someone")), (40, line(11, "someone"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs, classes=True).collect()}
    pairs = [(r.a_did, r.b_did) for r in line_dedup.line_links(docs).collect()]
    classes = {i: min(g) for g in groups_of([*range(30), 40, 50, 51], [p for p in pairs if LAST not in p]) for i in g}
    assert {k: r.class_id for k, r in got.items() if k is not None} == classes and len(set(classes.values())) < 20
    # rows follow the lines, not their pairs
    assert all(len(r.linked) <= r.n_lines for r in got.values()) and sum(r.n_links for r in got.values()) == 2 * len(pairs)


@pytest.mark.parametrize("hot", [line_dedup.HOT, 3])
def test_line_dedup_with_a_hot_segment(spark, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    base = "The common line that very many documents share with one small change only here."
    rows = [(i, "\n".join([base[:30] + "abcdefgh"[i % 8] + base[31:], base[: i % 60] + "#" + base[i % 60 + 1 : 60] + str(i)])) for i in range(150)]
    want, links = brute_lines(rows, line_dedup.LEAST)
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, bytes(r.text)) for r in got) == want and len(links) > 20


def test_line_dedup_of_accents_numbers_and_crowds(spark, monkeypatch):
    """Two changed digits and an accent are two edits at most, wherever they are; a crowd of similar lines loses no link."""
    monkeypatch.setattr(line_dedup, "HOT", 6)
    monkeypatch.setattr(line_dedup, "FINER", ((1, 8), (2, 8), (16, 0)))
    rng = np.random.default_rng(9)
    rows = [(1, "Une journée d'été à la plage"), (2, "Une journee d'eté à la plage"), (3, "Ein schöner Tag am See, 19"), (4, "Ein schoner Tag am See, 18"), (5, "x" * 40), (6, "x" * 41)]
    for i in range(60):
        line = list("Seen on page 000 of a very common notice, by reader 000.")
        for at in rng.integers(0, len(line), 2):
            line[at] = "0123456789"[rng.integers(0, 10)]
        rows.append((10 + i, "".join(line)))
    want, links = brute_lines(rows, line_dedup.LEAST)
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, bytes(r.text)) for r in got) == want and len(links) > 20
    assert sum(r.n_links for r in got) == 2 * len(links) and {2, 4, 6} <= {r.doc_id for r in got if r.n_removed}


def test_a_crowded_key_is_passed_through():
    """A key of 100,000 lines is never paired nor held: its lines come out alone."""
    n = 100_000
    rows = [np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int32), np.zeros(n, np.int32), np.ones(n, bool)]
    batches = (pa.RecordBatch.from_arrays([pa.array(c[k : k + 5000]) for c in rows], ["key", "did", "tie", "line", "own"]) for k in range(0, n, 5000))
    out = list(line_dedup.meet(batches, 48))
    assert sum(map(len, out)) == n and max(map(len, out)) <= 5000 and all(b.column(3).null_count == len(b) for b in out)


def test_line_dedup_keeps_columns(edge_docs, no_docs):
    kept = line_dedup.deduped_rows(edge_docs)
    assert kept.columns == edge_docs.columns and kept.where("text IS NULL OR key <> 'extra'").count() == 0
    assert line_dedup.deduped_rows(no_docs).count() == 0


# byte strings


def brute_strings(rows):
    seen, out = set(), {}
    for s, text in sorted({(spot(r[0], r[1]), body(r[1])) for r in rows}):
        mark = bytearray(len(text))
        for p in range(len(text) - 99):
            window = text[p : p + 100]
            if window in seen:
                mark[p : p + 100] = b"\1" * 100
            seen.add(window)
        runs = sum(1 for i, m in enumerate(mark) if m and (not i or not mark[i - 1]))
        out[s] = (len(text), sum(mark), runs, bytes(x for x, m in zip(text, mark, strict=True) if not m))
    return Counter((r[0], *out[spot(r[0], r[1])]) for r in rows)


def strings(docs, hot=suffix_dedup.HOT):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.left)) for r in suffix_dedup.suffix_dedup(docs, hot).collect())


def test_suffix_dedup(edge_docs, edge_rows, no_docs):
    assert strings(edge_docs) == brute_strings([r[:2] for r in edge_rows])
    assert not strings(no_docs)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 4])
def test_suffix_dedup_of_shared_passages(spark, hot):
    rng = np.random.default_rng(3)
    some = lambda n: rng.choice(list("xyz wvu"), n).tolist()
    phrase, passage = "A phrase of some sixty bytes that a lot of the documents hold.. ", "".join(rng.choice(list("abcdef ghij"), 400))
    parts = [phrase, passage, passage[:150], passage[100:260], phrase * 4, "ab" * 200, "q" * 350]
    rows = [(i, "".join(some(rng.integers(0, 150)) + [parts[rng.integers(0, len(parts))]] + some(rng.integers(0, 150)))) for i in range(150)]
    assert strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), hot) == brute_strings(rows)


@pytest.mark.parametrize("parts,hot", [(1, suffix_dedup.HOT), (6, suffix_dedup.HOT), (6, 2)])
def test_suffix_dedup_of_repeated_rows(spark, parts, hot):
    """Rows of one doc_id and text of over 200 bytes count once, whether a task has all of them or one; other copies still go."""
    rng = np.random.default_rng(8)
    some = lambda n: "".join(rng.choice(list("abcdef ghij"), n))
    one, two, passage = some(300), some(900), some(150)
    rows = [(1, one)] * 3 + [(2, passage + two)] * 4 + [(3, some(50) + passage + some(60)), (4, one), (None, two), (None, two), (5, passage * 3), (5, passage * 3)]
    want = brute_strings(rows)
    assert want[1, 300, 0, 0, one.encode()] == 3
    assert strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), hot) == want


def test_suffixes_are_sorted_by_bytes():
    rng = np.random.default_rng(4)
    text = rng.choice(np.frombuffer(b"ab", np.uint8), 3000).tobytes() + b"a" * 300
    at = rng.permutation(3000)[:700]
    group = np.sort(rng.integers(0, 9, 700))
    order = suffix_dedup.Suffixes(text).sort(at, group)
    want = [k for g in range(9) for k in sorted(np.flatnonzero(group == g).tolist(), key=lambda k: text[at[k] : at[k] + 100])]
    assert order.tolist() == want


def test_equal_windows_survive_hash_collisions(monkeypatch):
    text = bytes(range(256)) * 3
    at, group = np.array([0, 256, 1, 300]), np.zeros(4, np.int64)
    assert suffix_dedup.equal_windows(text, at, group).tolist() == [False, True, False, False]
    monkeypatch.setattr(suffix_dedup.Suffixes, "hash", lambda self, at, size: np.zeros(len(at), np.uint64))
    assert suffix_dedup.equal_windows(text, at, group).tolist() == [False, True, False, False]


# simhash


def brute_print(text, k=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), body(text)))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), seed=42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_keys_bridge_four_bits():
    rng = np.random.default_rng(6)
    one = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000).astype(np.uint64)
    two = one.copy()
    for i in range(len(two)):
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            two[i] ^= np.uint64(1) << np.uint64(b)
    golay = simhash.Golay()
    sets = []
    for prints in (one, two):
        keys = defaultdict(set)
        for k, r in zip(*simhash.bucket_keys(prints, golay), strict=True):
            keys[r].add(k)
        sets.append(keys)
    assert all(sets[0][i] & sets[1][i] for i in range(len(one)))


def test_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(7)
    prints = np.unique(np.array([0, (1 << 64) - 1], np.uint64)[rng.integers(0, 2, 200)] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)))
    edges = [(int(a), int(b)) for x, y in simhash.links(prints) for a, b in zip(x, y, strict=True)]
    assert len(edges) < len(prints) and all(bin(a ^ b).count("1") <= 4 for a, b in edges)
    want = {tuple(sorted(s)) for s in groups_of(prints.tolist(), [(a, b) for a in prints.tolist() for b in prints.tolist() if bin(a ^ b).count("1") <= 4])}
    assert {tuple(sorted(s)) for s in groups_of(prints.tolist(), edges)} == want


def groups_of(nodes, edges):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        up[max(top(a), top(b))] = min(top(a), top(b))
    out = defaultdict(set)
    for n in nodes:
        out[top(n)].add(n)
    return list(out.values())


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (300, 300), (7, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_many_edges(spark, monkeypatch):
    """Nodes with many edges each are contracted within tasks: the rounds, which join, get at most an edge a node."""
    import corpusloom.llm.components as module

    edges = [(base + i, base + j) for base, n in ((0, 50), (1000, 40)) for i in range(n) for j in range(i)] + [(i, i + 1) for i in range(2000, 2060)]
    seen, large = [], module._large
    monkeypatch.setattr(module, "_large", lambda e: seen.append(e.count()) or large(e))
    frame = spark.createDataFrame(edges, "a long, b long")
    want = {k: base for base, n in ((0, 50), (1000, 40), (2000, 61)) for k in range(base, base + n)}
    for chunk, most in ((7, len(edges)), (500, len(want)), (module.CHUNK, len(want))):
        seen.clear()
        monkeypatch.setattr(module, "CHUNK", chunk)
        assert {r.node: r.root for r in components(frame).collect()} == want
        assert max(seen) <= most


def test_simhash(edge_docs, edge_rows, no_docs):
    prints = {body(r[1]): brute_print(r[1]) for r in edge_rows}
    every = sorted(set(prints.values()))
    least = {}
    for group in groups_of(every, [(a, b) for a in every for b in every if bin(a ^ b).count("1") <= 4]):
        ids = [r[0] for r in edge_rows if prints[body(r[1])] in group and r[0] is not None]
        least |= {p: min(ids, default=None) for p in group}
    got = Counter((r.doc_id, r.print % (1 << 64), r.component_id) for r in simhash.near_dedup(edge_docs).collect())
    assert got == Counter((r[0], prints[body(r[1])], least[prints[body(r[1])]]) for r in edge_rows)
    assert simhash.near_dedup(no_docs).count() == 0


def test_one_of_each_near_copy(edge_docs, edge_rows, no_docs):
    kept = near_text.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and not {2, 3, 4} & set(ids), "copies and the near copy of document 1 go"
    assert ids[5] == 1 and not {6, 7} & set(ids), "of texts without words one stays"
    assert {8, 9, 10, 13, 14, 15} <= set(ids) and ids[13] == 2 and ids[None] == 1
    assert near_text.one_of_each(no_docs).count() == 0


def true_sets(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def true_groups(texts, least=0.8):
    sets = {i: true_sets(t) for i, t in texts.items()}
    ids = sorted(sets)
    alike = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    return {tuple(sorted(g)) for g in groups_of(ids, alike)}


def near_text_groups(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    out = defaultdict(set)
    for r in near_text.near_groups(docs).collect():
        out[r.root].add(r.doc_id)
    assert {r.doc_id for r in near_text.one_of_each(docs).collect()} == {min(g) for g in out.values()}
    return {tuple(sorted(g)) for g in out.values()}


def test_near_copies_with_passages_inserted_cut_or_changed(spark):
    """Pairs from 0.6 to 0.95: all those at 0.8 or more are one group each, none of the others is."""
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 8))) for _ in range(4000)]
    some = lambda n: [words[k] for k in rng.integers(0, len(words), n)]
    texts = {}
    for i in range(240):
        base = some(int(rng.integers(60, 400)))
        n = max(1, int(len(base) * rng.uniform(0.03, 0.35)))
        at = int(rng.integers(0, len(base) - n))
        copy = [base[:at] + some(n) + base[at:], base[:at] + base[at + n :], base[:at] + some(n // 2) + base[at + n // 2 :]][i % 3]
        texts |= {2 * i: " ".join(base), 2 * i + 1: " ".join(copy)}
    want = true_groups(texts)
    assert 60 < sum(len(g) == 2 for g in want) < 200
    assert near_text_groups(spark, texts) == want


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_text, "BLOCK", 64)
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 8))) for _ in range(2000)]
    base = [words[k] for k in rng.integers(0, len(words), 150)]
    texts = {}
    for i in range(200):
        copy = list(base)
        for at in rng.integers(0, len(base), 2 if i % 2 else 9):
            copy[at] = words[rng.integers(0, len(words))]
        texts[i] = " ".join(copy)
    want = true_groups(texts)
    assert max(map(len, want)) >= 100
    assert near_text_groups(spark, texts) == want


def test_sparse_groups_close_to_the_threshold(spark, monkeypatch):
    """Copies of a base whose pairs lie between some 0.78 and 0.84: every group that one pair holds together is found, in buckets far over SMALL."""
    monkeypatch.setattr(near_text, "POOLED", 50)
    rng = np.random.default_rng(13)
    words, texts = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 8))) for _ in range(3000)], {}
    for size, length, changed in ((60, 400, 5), (60, 400, 6), (60, 300, 4), (60, 200, 3), (120, 400, 5)):
        base = [words[k] for k in rng.integers(0, len(words), length)]
        for _ in range(size):
            copy = list(base)
            for at in rng.choice(length, changed + int(rng.integers(2)), replace=False):
                copy[at] = f"new{rng.integers(10**9)}"
            texts[len(texts)] = " ".join(copy)
    want = true_groups(texts)
    assert len(want) > 60 and sum(len(g) > 1 for g in want) > 5 and max(map(len, want)) > 90
    assert near_text_groups(spark, texts) == want


def test_near_apart_is_all_pairs():
    """Places near to another root, and what hangs together by that, against a loop over all pairs; both sides in one, and two blocks."""
    rng = np.random.default_rng(14)
    for n, sides, step in ((0, 1, 4), (1, 1, 4), (90, 1, 7), (90, 2, 7), (60, 2, 64)):
        base = rng.integers(0, 1 << 62, (6, 2))
        pick = rng.integers(0, 6, n)
        prints = [[int(base[p, k]) ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 20), replace=False)) for p in pick] for k in (0, 1)]
        one, two = (np.array(p, np.uint64) for p in prints)
        root = rng.integers(0, 8, n) + pick // 3 * 8
        side = np.full(n, 3) if sides == 1 else rng.integers(1, 3, n)
        near = [(i, j) for i in range(n) for j in range(n) if side[i] & 1 and side[j] & 2 and root[i] != root[j] and (prints[0][i] ^ prints[0][j]).bit_count() + (prints[1][i] ^ prints[1][j]).bit_count() <= near_text.SHINGLE_BITS]
        want = list(range(n))
        for _ in range(n):
            for i, j in near:
                want[i] = want[j] = min(want[i], want[j])
        at, label = near_text.near_apart(one, two, root, side, step)
        assert at.tolist() == sorted({k for pair in near for k in pair})
        assert label.tolist() == want
        assert n < 60 or len(near) > 50


def test_links_of_blocks_are_of_roots(spark):
    """What many nodes of two groups have in common is one link of their roots; and only some large buckets give pairs."""
    import pyarrow as pa

    sets = np.arange(50, dtype=np.uint64)
    side = lambda nodes, root: pa.table({"node": nodes, "one": [0] * len(nodes), "two": [0] * len(nodes), "root": [root] * len(nodes), "set": [sets.tobytes()] * len(nodes)})
    assert near_text.crossed(side([1, 2, 3], 1), side([7, 8], 7)).to_pylist() == [{"a": 1, "b": 7}] == near_text.crossed(side([4, 5], 1), side([9], 7)).to_pylist()
    rows = [(k, n, 0, 0) for k in range(8) for n in range(100)]
    met = pa.concat_tables(pa.Table.from_batches([b]) for b in near_text.candidates(iter([pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["key", "node", "one", "two"])])))
    assert met.filter(pa.array(x == 1 for x in met["part"].to_pylist())).num_rows == len(rows)
    assert 0 < met.filter(pa.array(x == 0 for x in met["part"].to_pylist())).num_rows <= 2 * 99
