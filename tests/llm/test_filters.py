import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contrail.llm.decontaminate import decontaminate, words
from contrail.llm.fm_index import FMIndex, WaveletMatrix, suffix_array
from contrail.llm.language_id import language_id
from contrail.llm.url_filter import Rule, host_rule, judge_urls
from contrail.llm.vector_search import top_k

DOCS = "doc_id long, text string"

# Decontamination -----------------------------------------------------------------------------


def test_fm_index_against_scan():
    rnd = np.random.default_rng(3)
    text = rnd.integers(1, 4, 300)
    order = suffix_array(np.r_[text, 0])
    suffixes = [np.r_[text, 0].tolist()[i:] for i in order]
    assert suffixes == sorted(suffixes)
    matrix = WaveletMatrix(text, 4)
    at = rnd.integers(0, 301, 200)
    symbol = rnd.integers(1, 5, 200)
    assert matrix.rank(symbol, at).tolist() == [int((text[:e] == s).sum()) for s, e in zip(symbol, at)]
    assert (matrix.access(np.arange(300)) == text).all()
    patterns, lengths = rnd.integers(1, 6, (80, 5)), rnd.integers(1, 6, 80)
    got = sorted(zip(*(x.tolist() for x in FMIndex(text, 4).occurrences(patterns, lengths))))
    want = [(p, i) for p in range(80) for i in range(300) if text[i : i + lengths[p]].tolist() == patterns[p, : lengths[p]].tolist()]
    assert got == want


def brute_hits(docs, items, width, share):
    windows = {}
    for item, text in items:
        w = words(text) if text is not None and item is not None else []
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = []
    for key, text in docs:
        w, hit, found = words(text or ""), set(), set()
        for window, names in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found |= names
        names = ",".join(sorted(found))
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and share * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination_against_scan(frame, spark, block_bytes):
    rnd = random.Random(2)
    text = lambda n: rnd.choice([" ", "--", "\n"]).join(rnd.choice("aBcéé1") for _ in range(n))
    docs = [(i, text(rnd.randint(0, 60))) for i in range(60)] + [(70, None), (71, ""), (None, "a B c"), (3, "!?"), (3, "!?"), (72, text(9000))]
    items = [(i, text(rnd.randint(3, 9))) for i in range(12)] + [(20, "a b"), (20, None), (None, "c"), (21, "!"), (22, "")]
    got = decontaminate(
        frame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), width=4, block_bytes=block_bytes
    ).drop("items", "spans")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_hits(docs, items, 4, 20)


def test_decontamination_of_empty_tables(frame, spark):
    docs, none = frame([(1, "a b c d")], DOCS), spark.createDataFrame([], "item_id long, text string")
    got = decontaminate(docs, none, carry=("key", "n")).first()
    assert (got.n_words, got.n_hit, got.contaminated, got.carried.key) == (4, 0, False, "x")
    assert decontaminate(docs.filter("false"), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


# Language identification ----------------------------------------------------------------------


def sentences(n):
    parts = {"en": ["the", "and", "ing", "tion", "th"], "de": ["der", "ung", "sch", "ß", "ein"], "es": ["ción", "ñ", "los", "que"]}
    rnd = random.Random(1)
    for i in range(n):
        lang = rnd.choice(list(parts))
        yield i, " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(30)), lang


def test_language_held_out_accuracy(frame):
    rows = list(sentences(300))
    odd = [(900, None, "en"), (901, "", "de"), (902, "12 !?", "es"), (None, rows[0][1], None), (903, rows[1][1] * 300, None), (4, rows[4][1], "en")]
    docs = frame(rows + odd, DOCS + ", lang string")
    got = {(r.doc_id, r.carried.text): r for r in language_id(docs, sample_rows=120, landmarks=12, carry=("text", "key")).collect()}
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0], r[1]].held_out == (r in test) for r in rows)
    assert np.mean([got[i, t].lang_pred == lang for i, t, lang in test]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    for i, t, _ in odd[:3]:
        assert (got[i, t].lang_pred, got[i, t].score) == ("und", 0)
    assert not got[None, rows[0][1]].held_out and got[903, rows[1][1] * 300].lang_pred == rows[1][2]


def test_language_does_not_read_labels_of_held_out_rows(frame):
    rows = list(sentences(150))
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    one, two = (
        {r.doc_id: (r.lang_pred, r.score) for r in language_id(frame(x, DOCS + ", lang string", 1), 200, 9).collect()} for x in (rows, wrong)
    )
    assert one == two


def test_language_without_labels(frame):
    docs = frame([(1, "abc", None), (2, None, None)], DOCS + ", lang string")
    assert {(r.lang_pred, r.score) for r in language_id(docs).collect()} == {("und", 0.0)}
    assert language_id(docs.filter("false")).count() == 0


# URL filters ----------------------------------------------------------------------------------

HOSTS = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "u.net", "/v1.2/x."), ("block", "u.net", "/a.b/")]
URLS = [
    None, "", "no scheme.org/", "http://", "HTTP://A.Example.ORG/es/x?y#z", "https://example.org/en/12", "http://badexample.org/es/1",
    "http://example.org?/es/", "http://x.org", "http://com/fr/", "http://com/FR/", "ftp://a.b.com/fr/?q", "http://spam.net/ads/1", "x://h#/",
    "http://u.net/v1.2/x.html", "http://u.net/v1.2/xy", "http://w.u.net/a.b/c", "http://u.net/" + "a/" * 5000, "http://a\nb.org/es/",
]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    path = rest[len(host) :]
    path = next((path[:i] for i, c in enumerate(path) if c in "?#"), path)
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in HOSTS if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "block" if "/ads/" in host + path else "allow"


def test_urls_against_all_rules(frame):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[4]), (4, URLS[4])]
    rules = [host_rule(*r) for r in HOSTS] + [Rule("block", "/ads/"), Rule("allow", "never", ("nowhere",))]
    got = judge_urls(frame(rows, "page_id long, url string"), rules).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((k, *brute_url(u)) for k, u in rows), key=repr)


def test_urls_without_rules_or_rows(frame):
    pages = frame([(1, "http://a.org/")], "page_id long, url string")
    assert tuple(judge_urls(pages, []).first()) == (1, "a.org", "/", None, "allow")
    assert judge_urls(pages.filter("false"), [host_rule(*HOSTS[0])]).count() == 0


# Exact top-k ----------------------------------------------------------------------------------


@pytest.mark.parametrize("cells,queries", [(48, 4096), (2, 3), (7, 1)])
def test_top_k_against_all_pairs(frame, cells, queries):
    rnd = np.random.default_rng(5)
    vectors = [rnd.normal(size=6).round(2).tolist() for _ in range(60)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(100 + i, vectors[3]) for i in range(9)]  # ties
    rows += [(200, None), (205, [1.0, None]), (210, [float("nan")] * 6), (215, [float("inf")]), (None, vectors[0]), (220, [1.0]), (225, []), (7, vectors[7])]
    df = frame(rows, "vec_id long, embedding array<float>")
    got = top_k(df, F.col("vec_id") % 5 == 0, k=5, least_cells=cells, most_queries=queries).collect()
    good = [(i, np.floor(256 * np.array(np.float32(v + [0] * (6 - len(v))), np.float64)).astype(int)) for i, v in rows
            if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = []
    for q, v in good:
        if q % 5 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_few_rows(frame):
    df = frame([(0, [1.0, 2.0]), (5, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 5 == 0).collect())) == [(0, 1, 5, 128 * 256 + 128 * 512), (5, 1, 0, 128 * 256 + 128 * 512)]
    assert top_k(df, F.col("vec_id") == 1).count() == 0
    assert top_k(df.filter("false"), F.col("vec_id") % 5 == 0).count() == 0
