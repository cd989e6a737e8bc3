import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from contrail.llm.components import components
from contrail.llm.line_dedup import dedup_lines
from contrail.llm.set_join import similar_documents
from contrail.llm.simhash import fingerprint, near_duplicates, shingle_hashes
from contrail.llm.suffix_dedup import common_prefix, dedup_substrings, multikey_order
from contrail.llm.trie_join import traverse
from contrail.sources.scratch import materialize

DOCS = "doc_id long, text string"


def roots(names, links):
    root = {n: n for n in names}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in names}


# Suffix-array dedup --------------------------------------------------------------------------


def brute_substrings(rows, width):
    count = Counter(b[i : i + width] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - width + 1))
    out = []
    for key, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        left = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(y and not (i and gone[i - 1]) for i, y in enumerate(gone))
        out.append((key, len(b), len(b) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def substring_rows():
    rnd = random.Random(3)
    text = lambda n, of: "".join(rnd.choice(of) for _ in range(n))
    shared = [text(60, "abcdef") for _ in range(4)]
    rows = [
        (i, text(rnd.randint(0, 50), "abcdefgh") + rnd.choice(shared)[rnd.randint(0, 20) : rnd.randint(30, 60)]
         + text(rnd.randint(0, 30), "abcé") + (rnd.choice(shared) if i % 3 else "")) for i in range(150)
    ]
    rows += [(200, None), (201, ""), (202, "ab" * 100), (203, "x" * 150), (None, rows[5][1]), (5, rows[5][1])]
    return rows + [(204, "\0" * 90 + "q"), (205, "z" + "\0" * 60), (206, text(20_000, "abcdefghijkl"))]


@pytest.mark.parametrize("width,gram,partitions", [(20, 8, 3), (24, 16, 2), (64, 8, 5)])
def test_substrings_against_brute_force(frame, width, gram, partitions):
    rows = substring_rows()
    got = dedup_substrings(frame(rows, DOCS, partitions), width, gram).drop("kept", "spans").collect()
    assert sorted(map(tuple, got), key=repr) == brute_substrings(rows, width)


def test_long_texts_in_pieces(frame, monkeypatch):
    rnd = random.Random(9)
    passage = "".join(rnd.choice("abcdefgh") for _ in range(90))
    rows = [(1, passage.join("".join(rnd.choice("pqrst") for _ in range(700)) for _ in range(3))), (2, "." + passage)]
    from contrail.llm import suffix_dedup

    whole = np.frombuffer(rows[0][1].encode(), np.uint8)
    ends = np.array([0, len(whole)])
    first, last, *_ = suffix_dedup.stretches(whole, ends, 40, 8)
    assert sum(last - first + 1) == len(whole) - 39  # every string belongs to one stretch
    got = dedup_substrings(frame(rows, DOCS), 40, 8).drop("kept", "spans").collect()
    assert sorted(map(tuple, got), key=repr) == brute_substrings(rows, 40)


def test_multikey_order():
    rnd = np.random.default_rng(2)
    words = rnd.integers(0, 3, (400, 4)).astype(np.uint64) << np.uint64(56)
    order = multikey_order(words)
    rows = [tuple(r) for r in words[order].tolist()]
    assert rows == sorted(rows)
    want = [0] + [len(__import__("os").path.commonprefix([a.tobytes(), b.tobytes()])) for a, b in zip(words[order][:-1].astype(">u8"), words[order][1:].astype(">u8"))]
    assert common_prefix(words, order).tolist() == want


# Line dedup -----------------------------------------------------------------------------------


def brute_lines(rows, least):
    filled = {}
    for key, text in rows:
        lines = (text or "").split("\n")
        filled[key, text] = [(i, x) for i, x in enumerate(lines) if x and not x.isspace()]
    order = sorted(filled, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest()))
    seen, gone = {}, {r: set() for r in filled}
    for place, r in enumerate(order):
        lines = [x for _, x in filled[r]]
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[s:e]) >= least:
                    if seen.setdefault(tuple(lines[s:e]), (place, s)) != (place, s):
                        gone[r].update(i for i, _ in filled[r][s:e])
    out = []
    for key, text in rows:
        drop, n = gone[key, text], len(filled[key, text])
        lines = (text or "").split("\n")
        kept = text if not drop else "" if len(drop) == n else "\n".join(x for i, x in enumerate(lines) if i not in drop)
        out.append((key, kept, n, len(drop)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [1, 4, 9])
def test_lines_against_brute_force(frame, least):
    rnd = random.Random(least)
    line = lambda: " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 4)))
    blocks = [[line() for _ in range(rnd.randint(1, 7))] for _ in range(8)]
    rows = [(i, "\n".join(sum((rnd.choice(blocks) + [line()] for _ in range(rnd.randint(0, 4))), []))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, rows[3][1]), (103, rows[3][1]), (103, rows[3][1]), (104, "a a\n" * 40)]
    got = dedup_lines(frame(rows, DOCS), least).collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows, least)


def test_lines_carry_columns_and_empty_tables(frame):
    docs = frame([(1, "a b\nc"), (2, "a b\nc")], DOCS)
    got = dedup_lines(docs, 3, carry=("n", "key", "doc_id")).orderBy("doc_id").collect()
    assert [(r.text, r.carried.n, r.carried.key, r.carried.doc_id) for r in got] == [("a b\nc", 1, "x", 1), ("", 1, "x", 2)]
    assert dedup_lines(docs.filter("false")).count() == 0


# SimHash --------------------------------------------------------------------------------------


def test_trie_join_against_all_pairs():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**63, 150, dtype=np.uint64) * np.uint64(2)
    values = set(base.tolist())
    for v in base[:80].tolist():
        for _ in range(rnd.integers(1, 12)):
            x = v
            for k in rnd.integers(0, 64, rnd.integers(1, 6)):
                x ^= 1 << int(k)
            values.add(x)
    values = np.sort(np.array(list(values), np.uint64))
    sides = values[values < 1 << 63], values[values >= 1 << 63]
    for budget in (0, 1, 4, 7):
        a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values[None]) <= budget)
        want = roots(values.tolist(), zip(values[a].tolist(), values[b].tolist()))
        got = values[traverse(values, None, budget)].tolist()
        assert roots(values.tolist(), got) == want
        got = [e for i in (0, 1) for e in sides[i][traverse(sides[i], None, budget, 1)].tolist()]
        got += np.concatenate(sides)[traverse(*sides, budget, 1, 1)].tolist()
        assert roots(values.tolist(), got) == want


@pytest.mark.parametrize("leaf", [4, 1000])
def test_near_duplicates_against_all_pairs(frame, leaf):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(4))
    rows = []
    for i in range(40):
        text = [word() for _ in range(rnd.choice([0, 2, 4, 300]))]
        rows.append((3 * i, " ".join(text)))
        if len(text) > 9:
            text[rnd.randrange(len(text))] = word()
            rows.append((3 * i + 1, "\t".join(text).upper()))
    rows += [(500, None), (501, "  "), (None, rows[0][1]), (rows[3]), (502, "x " * 20_000)]
    got = near_duplicates(frame(rows, DOCS), width=4, budget=4, leaf=leaf).collect()
    fps = [(k, fingerprint(t or "", 4)) for k, t in rows]
    different = sorted({f for _, f in fps})
    root = roots(different, [(a, b) for a in different for b in different if (a ^ b).bit_count() <= 4])
    least = {}
    for k, f in fps:
        if k is not None:
            least[root[f]] = min(k, least.get(root[f], k))
    assert sorted(map(tuple, got), key=repr) == sorted(((k, f"{f:016x}", least[root[f]]) for k, f in fps), key=repr)
    assert near_duplicates(frame(rows, DOCS).filter("false")).count() == 0


def test_similar_documents_against_all_pairs(frame):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(30):
        text = [word() for _ in range(250)]
        rows.append((10 * i, " ".join(text)))
        for k in range(1, 4):  # one edit, few edits, too many
            for _ in range((1, 4, 40)[k - 1]):
                text[rnd.randrange(len(text))] = word()
            rows.append((10 * i + k, " ".join(text)))
    rows += [(900, None), (901, ""), (902, rows[0][1]), (903, "one two"), (904, "One  two")]
    sets = {k: set(shingle_hashes(t or "", 5)) for k, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    got = {r.doc_id: r.component_id for r in similar_documents(frame(rows, DOCS)).collect()}
    assert got == want


def edited_text(rnd, words, kind, share):
    """Words with ``share`` of them appended, cut or changed."""
    k = int(len(words) * share)
    if kind == "appended":
        return words + [rnd.choice(words) for _ in range(k)]
    if kind == "cut":
        return words[: len(words) - k]
    at = rnd.randrange(len(words) - k)
    return words[:at] + [rnd.choice(words) for _ in range(k)] + words[at + k :]


def similar_exactly(frame, rows):
    sets = {k: set(shingle_hashes(t or "", 5)) for k, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in similar_documents(frame(rows, DOCS)).collect()}
    assert got == roots(sets, links)
    return len(links)


def test_similar_documents_of_a_large_group(frame):
    """Variants at all distances of one text: the nearest by any sketch is often not similar enough, another one is."""
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(3000)}" for _ in range(120)]
    rows = []
    for i in range(700):
        text = list(base)
        for _ in range(rnd.randrange(1, 9)):
            text[rnd.randrange(len(text))] = f"x{rnd.randrange(3000)}"
        rows.append((i, " ".join(text)))
    assert similar_exactly(frame, rows) > 1000


def test_similar_documents_by_kind_of_change(frame):
    rnd, rows = random.Random(10), []
    for size, kinds in ((250, 3000), (250, 300), (60, 3000), (8, 50)):
        for i in range(12):
            base = [f"{size}v{i % 3}n{rnd.randrange(kinds)}" for _ in range(size)]
            rows.append((len(rows), " ".join(base)))
            for kind in ("appended", "cut", "changed"):
                for share in (0.05, 0.1, 0.19):
                    rows.append((len(rows), " ".join(edited_text(rnd, base, kind, share))))
    assert similar_exactly(frame, rows) > 300


@pytest.mark.parametrize("order", ["none", "by few rows", "any"])
def test_similar_documents_under_any_order_of_shingles(frame, monkeypatch, order):
    from contrail.llm import set_join

    rnd, rows = random.Random(11), []
    for i in range(20):
        base = [f"v{i % 4}n{rnd.randrange(60)}" for _ in range(80)]
        for kind in ("appended", "cut", "changed"):
            for share in (0.0, 0.05, 0.12, 0.19):
                rows.append((len(rows), " ".join(["one common opening of all texts here", *edited_text(rnd, base, kind, share)])))
    own = set_join._common_shingles
    every = np.unique(np.array([h for _, t in rows for h in shingle_hashes(t, 5)], np.int64).view(np.uint64))
    some = every[np.random.default_rng(1).random(len(every)) < 0.5]
    orders = {
        "none": lambda *_: (np.zeros(0, np.uint64), np.zeros(0, np.int64)), "by few rows": lambda rows, width: own(rows, width, most=1),
        "any": lambda *_: (some, np.random.default_rng(2).permutation(len(some))),
    }
    monkeypatch.setattr(set_join, "_common_shingles", orders[order])
    assert similar_exactly(frame, rows) > 200


def test_components(spark):
    rnd = random.Random(6)
    links = [(i, i + 1) for i in range(60)] + [(200, 100 + i) for i in range(50)] + [(7, 7), (300, 301), (301, 300)]
    links += [(rnd.randrange(400, 480), rnd.randrange(400, 480)) for _ in range(50)]
    want = roots({x for e in links for x in e}, links)
    got = {r.a: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {k: got.get(k, k) for k in want} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_links_need_no_rounds(spark, monkeypatch):
    from contrail.llm import components as module

    n, written = 300, []
    chain = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(-5, -4), (-4, -5), (7, 7)], "a long, b long")
    monkeypatch.setattr(module, "materialize", lambda df, name: written.append(name) or materialize(df, name))
    found = {r.a: r.root for r in components(chain).collect()}
    assert found == {**{k: 0 for k in range(1, n + 1)}, -4: -5}
    assert len(written) <= 2
    monkeypatch.setattr(module, "PART", 50)  # several parts
    written.clear()
    assert {r.a: r.root for r in components(chain).collect()} == found and len(written) > 2
