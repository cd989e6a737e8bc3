import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from contrail.llm.collocations import collocations
from contrail.llm.filter_audit import audit_filters
from contrail.llm.hash_tree import PIECE, Shard, even_tree, place_documents, shard_of, write_shards

DOC = "doc_id long, text string, lang string, source string"
TREE = even_tree(8)


def test_shards_move_only_where_weights_changed(spark):
    from pyspark.sql import functions as F

    grown = [*TREE, Shard("r2", "k4", 8)]
    heavier = [Shard(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in TREE]
    key = F.col("id").cast("string")
    rows = spark.range(20_000).select(shard_of(key, TREE).alias("a"), shard_of(key, grown).alias("b"), shard_of(key, heavier).alias("c")).collect()
    assert all(r.a == r.b or r.b == 8 for r in rows)
    counts = Counter(r.b for r in rows)
    assert set(counts) == set(range(9)) and all(abs(n - 20_000 / 9) < 250 for n in counts.values())
    # Shards 0 to 3 are in the region whose weight stays; nothing moves between them.
    assert all(r.a == r.c or r.c >= 4 for r in rows)
    share = Counter(r.c for r in rows)
    assert abs(share[5] - 20_000 * 3 / 10) < 300


def test_place_documents(spark, frame, tmp_path):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, "", "ä" * 50, "x y", "long " * 9000]), "en", "s") for _ in range(800)]
    rows += [(7, "same", "en", "s")] * (PIECE * 2 + 5)  # more than one piece of identical rows
    got = place_documents(frame(rows, DOC), TREE, [*TREE, Shard("r2", "k4", 8)], carry=("lang",))
    write_shards(got.select("doc_id", "size", "shard", "slot"), f"{tmp_path}/out", 1000)
    found = got.collect()
    size = Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == size
    slots, of_key = defaultdict(list), defaultdict(set)
    for r in found:
        slots[r.shard].append(r.slot)
        of_key[r.doc_id].add((r.shard, r.grown_shard))
        assert r.law == "key" and r.grown_shard in (r.shard, 8) and r.carried.lang == "en"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_key.values())
    back = spark.read.parquet(f"{tmp_path}/out").groupBy("shard").count().collect()
    assert {r["shard"]: r["count"] for r in back} == {k: len(s) for k, s in slots.items()}
    assert place_documents(frame([], DOC), TREE).count() == 0
    with pytest.raises(ValueError):
        place_documents(frame(rows[:1], DOC), [Shard("a", "b", 1), Shard("a", "c", 1)])


def phrases_by_hand(rows, least, longest, absorb, most):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates, found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}, []
        for p, a in candidates.items():
            over = max((b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))), default=0)
            if over and 100 * over >= absorb * a:
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("longest,shards,counters", [(3, 3, 1 << 10), (4, 2, 1 << 16), (2, 1, 2)])
def test_collocations(frame, longest, shards, counters):
    rnd = random.Random(longest)
    words = ["a", "the", "The", "of", "naïve", "\x1cx", "日本", "b2", "zz"]
    rows = []
    for i in range(120):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", "\t", "  ", ", ", ".", "\n"]) for _ in range(rnd.randint(0, 60)))
        rows.append((i, text, rnd.choice(["en", "de", None]), "s"))
    rows += [(200, None, "en", "s"), (201, "", None, "s"), (202, "of the a " * 4000, "fr", "s"), (203, "?!.,", "xx", "s")] + [rows[3]] * 3
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    got = collocations(frame(rows, DOC), least=5, longest=longest, most=25, shards=shards, counters=counters)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == phrases_by_hand(rows, 5, longest, 50, 25)


def test_collocations_of_segments(frame, monkeypatch):
    monkeypatch.setattr("contrail.llm.collocations.SEGMENT", 64)
    rows = [(i, "one two three four. one two " * 5 + "x" * 100, "en", "s") for i in range(4)]
    got = collocations(frame(rows, DOC), least=10, counters=1 << 10)
    assert [(r.phrase, r.a) for r in got.orderBy("rank").collect()] == [(p, a) for _, _, p, a, *_ in phrases_by_hand(rows, 10, 3, 50, 2000)]
    assert collocations(frame([], DOC), counters=1 << 10).count() == 0


def test_counters_follow_the_words(frame, monkeypatch):
    from contrail.llm import collocations as module

    assert all(n / 8 < module.fit_counters(n) <= max(n / 4, 1 << 16) for n in (0, 10**5, 10**7, 135_896_475, 10**9))
    assert module.fit_counters(1 << 40) == module.MOST_COUNTERS
    # Frequent words, nearly all of their pairs infrequent: few of these pairs are counted exactly.
    rnd, scans = random.Random(5), []
    rows = [(i, " ".join(f"w{rnd.randrange(900)}" for _ in range(600)) + ". one two", "en", "s") for i in range(60)]
    monkeypatch.setattr(module, "LEAST_COUNTERS", 1 << 4)
    monkeypatch.setattr(module, "new_path", lambda spark, name, own=module.new_path: scans.append(own(spark, name)) or scans[-1])
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    docs = frame(rows, DOC)
    got = module.collocations(docs)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == phrases_by_hand(rows, 10, 3, 50, 2000)
    counted = sum(docs.sparkSession.read.parquet(p).filter("phrase is not null").count() for p in scans if "/scan-" in p)
    assert 0 < counted < 36_000 / 4


def audit_by_hand(rows, labels):
    good, toxic = ({k for k, *v in labels if v[i] == 1} for i in (0, 1))
    first = {}
    for k, t, *_ in rows:
        if k is not None:
            first[t or ""] = min(k, first.get(t or "", k))
    judged = defaultdict(list)
    for k, t, _, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": k is not None and k > first[t],
        }
        judged[part or ""].append((k, {f for f, x in fails.items() if x}))
    out = []
    for part, docs in judged.items():
        steps, sums = [], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = sum(f in x for _, x in docs)
                alone = sum(x == {f} for _, x in docs)
                sums[f] += len(gone)
                lost = [sum(k in kind for k, _ in gone if k is not None) for kind in (good, toxic)]
                steps.append((part, order, step, len(left), len(gone), failing - len(gone), alone, *lost))
        out += [(*s, sums[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_audit(spark, frame):
    rnd = random.Random(5)
    texts = ["word " * 250, " ".join(f"w{i}" for i in range(220)), "Short Text", "a # b", "", None, "ÄÖ " * 3, "X" * 30 + " y$", " ".join(f"v{i}" for i in range(9000))]
    rows = [(rnd.choice([None, *range(60)]), rnd.choice(texts), "en", rnd.choice([None, "", "s1", "s2"])) for _ in range(150)] + [(900, "alone # " * 120, "en", "s3")]
    labels = [(k, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for k in range(70)] + [(3, 1, 1), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", labels_extra())
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = sorted(tuple(r[c] for c in names) for r in audit_filters(frame(rows, DOC), table).collect())
    assert got == audit_by_hand(rows, labels)
    assert audit_filters(frame([], DOC), table).count() == 0
    assert audit_filters(frame(rows[:1], DOC), table.filter("false")).count() == 600


def labels_extra():
    from pyspark.sql import functions as F

    return F.lit("clash")
