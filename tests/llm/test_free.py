"""Operators with numpy inside tasks, and the pipeline, against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsefold.llm import bagminhash, decontaminate, graph, kernels, langid, lm, neardup, quality

from .conftest import COLUMNS, prose

WORD = re.compile("[^\x20\x09-\x0d]+")


def bag(text, n=5):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else Counter()


def overlap(a, b):
    common = sum((a & b).values())
    return common / max(1, sum(a.values()) + sum(b.values()) - common)


# kernels


def test_words_and_shingles_of_chunks(monkeypatch):
    monkeypatch.setattr(kernels, "CHUNK", 40)
    r = random.Random(3)
    texts = ["", None, " ", "é", "a b", *("".join(r.choice("ab é\n\t\x85 😀") for _ in range(r.randint(0, 60))) for _ in range(80))]
    seen = {}
    for first, last, t in kernels.texts_of(pa.array(texts)):
        hashes = t.hashes()
        for i in range(first, last):
            own = WORD.findall(texts[i] or "")
            rows = np.flatnonzero(t.doc == i - first)
            assert [bytes(t.data[a:b]).decode() for a, b in zip(t.start[rows], t.end[rows], strict=True)] == own
            for w, h in zip(own, hashes[rows], strict=True):
                assert seen.setdefault(w, h) == h
        _, doc = kernels.shingles(t, hashes)
        assert Counter(doc.tolist()) == Counter({i - first: sum(bag(texts[i]).values()) for i in range(first, last) if bag(texts[i])})
    assert len(set(seen.values())) == len(seen)


# quality


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    triples = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {i + k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_counts(odd, none, clashing):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = quality.judge(quality.measured(odd)).collect()
    assert len(rows) == 13
    for r in rows:
        n = counts(r["text"])
        assert tuple(r[c] for c in names) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(quality.measured(none)).count() == 0
    assert sum(r["kept"] for r in quality.judge(quality.measured(clashing)).collect()) == sum(r["kept"] for r in rows)


def test_repeated_lines_and_windows(spark):
    texts = ["a b c a b c", "x\nx\n\n \n \nx", "a a a a", "a b a b", "one\ntwo\none \none"]
    df = quality.measured(spark.createDataFrame([(t,) for t in texts], "text string"))
    for r in df.collect():
        assert tuple(r[1:]) == counts(r["text"])


def test_thresholds_adapt_to_the_source(spark):
    r = random.Random(4)
    noisy = [(i, " ".join(w + ("$" if r.random() < 0.3 else "") for w in prose(i, 100).split()), "en", "noisy", 0) for i in range(300)]
    plain = [(1000 + i, prose(1000 + i, 100), "en", "plain", 0) for i in range(300)]
    odd = [(5000, " ".join(w + "$" for w in prose(7, 100).split()), "en", "plain", 0), (5001, noisy[0][1], "en", "plain", 0)]
    df = spark.createDataFrame(noisy + plain + odd, COLUMNS)
    kept = {x["doc_id"] for x in quality.judge(quality.measured(df)).filter("kept").collect()}
    assert len({x[0] for x in plain} & kept) > 295 and len({x[0] for x in noisy} & kept) > 295
    assert not kept & {5000, 5001}


def test_thresholds_differ_between_the_groups_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    limits = quality.thresholds(quality.sketches(quality.measured(docs), "lang", "source")).collect()
    assert len(limits) == 80
    for measure in ("lines", "repeats", "length"):
        assert len({round(x[f"t_{measure}"], 4) for x in limits}) > 40


def test_fences_of_merged_sketches(spark):
    """The sketches of two sources, added up, give the quantiles of all their texts within the accuracy."""
    r = np.random.default_rng(2)
    rows = [("en", s, int(n), int(n * x), 0, 0, 0) for s in ("a", "b") for n, x in zip(r.integers(50, 500, 400), r.lognormal(1.5, 0.4, 400), strict=True)]
    rows += [("en", "a", 10, 10**6, 0, 0, 0)]  # fails a fixed rule, so it doesn't count
    df = spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    got = quality.fences(quality.sketches(df, "lang", "source"), ["lang"]).filter("measure = 'length'").first()
    true = np.sort([x[3] / x[2] for x in rows[:-1]])
    assert got["texts"] == 800
    tail, margin, _ = quality.MEASURES["length"]
    assert got["fence"] == pytest.approx(true[int(800 * tail) - 1] * (1 + margin) - margin * true[399], rel=0.04)


def test_small_groups_follow_the_wider_one(spark):
    """By weight: a group of one text hardly moves its threshold, one of as many as PRIOR meets it half way."""
    word = lambda n: " ".join("x" * n for _ in range(60))
    rows = [(i, word(4), "en", "wide", 0) for i in range(1000)] + [(2000 + i, word(8), "en", "half", 0) for i in range(quality.PRIOR)] + [(3000, word(8), "en", "one", 0)]
    rows = [(i, t + " " + prose(i, 60), *x) for i, t, *x in rows]
    df = quality.measured(spark.createDataFrame(rows, COLUMNS))
    t = {x["__source"]: x["t_length"] for x in quality.thresholds(quality.sketches(df, "lang", "source")).collect()}
    assert t["wide"] < t["one"] < t["half"] and t["one"] - t["wide"] < 0.5 * (t["half"] - t["wide"])


# near duplicates


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(9)
    for _ in range(5):
        elements = r.integers(1, 2**62, 50).astype(np.uint64)
        v, w = r.integers(0, 12, (2, 50))
        w = np.where(r.random(50) < 0.7, v, w)
        doc = np.repeat([0, 1], [np.count_nonzero(v), np.count_nonzero(w)])
        times = bagminhash.signatures(doc, np.concatenate([elements[v > 0], elements[w > 0]]), np.concatenate([v[v > 0], w[w > 0]]), 2, 4000)
        assert (times[0] == times[1]).mean() == pytest.approx(np.minimum(v, w).sum() / np.maximum(v, w).sum(), abs=0.04)


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (10, 11), (12, 11), (20, 20)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 7), 1), 10: 10, 11: 10, 12: 10, 20: 20}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def classes_of(rows):
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [bag(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and overlap(bags[i], bags[j]) >= 0.8:
                parent[top(i)] = top(j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), id_), id_)
    return [least[top(i)] for i in range(len(rows))]


def test_near_duplicate_classes(spark):
    r = random.Random(8)
    rows = []
    for g in range(25):
        words = prose(100 + g, r.choice([4, 7, 60, 200])).split()
        for _ in range(r.choice([1, 2, 6])):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(r.randint(0, 2)):  # a chain: each text is near the one before
                words[r.randrange(len(words))] = prose(r.randrange(10**6), 1)
    rows += [(len(rows) + i, t) for i, t in enumerate(["", None, "  ", "w", "w", "rep " * 30, "rep " * 34, "rep " * 60])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: x["class_id"] for x in neardup.mark(df).collect()}
    want = classes_of(rows)
    assert got == {id_: c for (id_, _), c in zip(rows, want, strict=True)}
    kept = {x["doc_id"] for x in neardup.deduplicated(df).collect()}
    assert kept == set(want)


def classes_by_id(df, **parameters):
    rows, contents = neardup.classes(df, **parameters)
    return {x["id"]: x["class_id"] for x in rows.join(contents, "key").collect()}


def test_links_between_texts_that_are_far_from_their_hub(spark):
    """With single registers as bands all texts share buckets; the links found must be those of all pairs."""
    base = prose(5, 100).split()
    rows = []
    for i in range(12):
        words = list(base)
        for k in range(i, i + 30):  # neighbours share most edits, distant ones few
            words[(k * 3) % 100] = f"edit{k}"
        rows.append((i, " ".join(words)))
    got = classes_by_id(spark.createDataFrame(rows, "doc_id long, text string"), registers=130, band=1)
    assert [got[i] for i in range(12)] == classes_of(rows)


def test_large_groups_of_excerpts_and_of_near_copies(spark):
    """Excerpts of one text, two families of near copies that are 0.75 alike, texts with a long passage in common."""
    r = random.Random(21)
    base = prose(50, 900).split()
    rows = []
    for _ in range(250):
        a = r.randrange(0, 700)
        rows.append((len(rows), " ".join(base[a : a + r.randint(60, 900)])))
    one = prose(51, 260).split()
    two = one[:222] + prose(52, 38).split()
    for family in (one, two):
        for _ in range(120):
            words = list(family)
            words[r.randrange(len(words))] = f"x{r.randrange(10**9)}"
            rows.append((len(rows), " ".join(words)))
    passage = prose(53, 150)
    rows += [(len(rows) + i, f"{prose(6000 + i, 60)} {passage}") for i in range(150)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = dict(zip([i for i, _ in rows], classes_of(rows), strict=True))
    assert classes_by_id(df, registers=130, band=1) == want
    assert classes_by_id(df) == want
    assert len(set(want.values())) > 150


def linked_pairs(texts):
    """The pairs of different texts at the similarity, by an index from shingles to texts."""
    bags = [bag(t) for t in texts]
    holders, common = {}, Counter()
    for i, x in enumerate(bags):
        for element, n in x.items():
            for j, m in holders.get(element, ()):
                common[j, i] += min(n, m)
            holders.setdefault(element, []).append((i, n))
    size = [sum(x.values()) for x in bags]
    return [(i, j) for (i, j), n in common.items() if n >= 0.8 * (size[i] + size[j] - n)]


def test_recall_of_links_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    got = classes_by_id(docs)
    pairs = linked_pairs([t for _, t in rows])
    assert len(pairs) > 30
    assert all(got[rows[i][0]] == got[rows[j][0]] for i, j in pairs)


def test_candidates_are_those_of_all_pairs(spark):
    """The filters lose no pair at the similarity, the very similarity included, whatever the components are."""
    r = random.Random(31)
    words = [f"w{i}" for i in range(12)]
    texts = sorted({" ".join(r.choice(words) for _ in range(r.randint(5, 9))) for _ in range(60)})
    base = prose(70, 17).split()
    texts += [" ".join(base), " ".join(base[:16] + ["q"]), " ".join(base + ["z"]), " ".join(["z", *base[1:]])]
    rows = [(i, t) for i, t in enumerate(texts)]
    for k in range(40):
        w = texts[r.randrange(60)].split()
        w.insert(r.randrange(len(w)), "w0")
        rows.append((100 + k, " ".join(w)))
    rows = list({t: (i, t) for i, t in rows}.values())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = df.select("doc_id", neardup.content_key("text").alias("key"))
    id_of = {bytes(x["key"]): x["doc_id"] for x in keyed.collect()}
    bags = neardup._bags_of(df, keyed.select("key"), "text")
    pairs = linked_pairs([t for _, t in rows])
    ids = [i for i, _ in rows]
    for labels in (F.col("key"), F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("00"))).otherwise(F.col("key"))):
        open_ = keyed.select("key", labels.alias("label"))
        label = {x["doc_id"]: bytes(x["label"]) for x in keyed.select("doc_id", labels.alias("label")).collect()}
        found = neardup._candidates(bags, open_, 0.8)
        linked = {frozenset((id_of[bytes(a)], id_of[bytes(b)])) for a, b in neardup._linked_pairs(found, bags, 0.8).collect()}
        assert linked == {frozenset((ids[i], ids[j])) for i, j in pairs if label[ids[i]] != label[ids[j]]}


def test_near_duplicates_of_odd_tables(odd, none, clashing):
    out = [(x["doc_id"], x["class_id"]) for x in neardup.mark(odd).collect()]
    assert out.count((1, 1)) == 2 and (2, 1) in out and (4, 4) in out and (None, None) in out and len(out) == 13
    assert neardup.mark(none).count() == 0 and neardup.deduplicated(none).count() == 0
    assert sorted(map(str, out)) == sorted(str((x["doc_id"], x["class_id"])) for x in neardup.mark(clashing).collect())
    kept = [x["doc_id"] for x in neardup.deduplicated(odd).collect()]
    assert kept.count(1) == 1 and 2 not in kept


def test_different_texts_with_null_or_repeated_ids_stay(spark):
    near = prose(40, 200)
    rows = [(None, prose(i, 60)) for i in range(5)] + [(7, prose(i, 60)) for i in range(10, 14)]
    rows += [(7, near), (7, near + " more"), (None, near + " again"), (None, prose(0, 60)), (None, ""), (None, None), (None, " ")]
    got = [tuple(x) for x in neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert Counter(x for x in got if near not in (x[1] or "")) == Counter(rows[:9] + rows[-3:])
    (one,) = (x for x in got if near in (x[1] or ""))
    assert one in rows[9:11]


# decontamination


def test_leaks_of_items(spark, odd, none):
    items = [(i, prose(900 + i, n)) for i, n in enumerate((1, 3, 4, 5, 6, 20, 37, 37, 80))] + [(50, None), (51, " ")]
    r = random.Random(12)
    docs = []
    for i in range(60):
        words = prose(2000 + i, r.choice([0, 30, 200])).split()
        k = r.randrange(12)
        if k < 9:
            inner = items[k][1].split()
            if i % 2 and len(inner) > 15:
                inner[r.choice([0, -1])] = "other"
            at = r.randint(0, len(words))
            words[at:at] = [w.upper() if i % 3 == 0 else w for w in inner]
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["id"], x["item_id"]): x["similarity"] for x in decontaminate.leaks(df, bench).collect()}
    want = {}
    for d, text in docs:
        w = text.lower().split()
        for i, item in items:
            n = len((item or "").split())
            if n:
                b = bag(item)
                size = len(next(iter(b)))
                of = lambda part: Counter(tuple(part[k : k + size]) for k in range(len(part) - size + 1))
                best = max((overlap(of(w[s : s + n]), b) for s in range(len(w) - n + 1)), default=0)
                if best >= 0.8:
                    want[d, i] = best
    assert got.keys() == want.keys() and len(got) > 30
    assert all(got[k] == pytest.approx(want[k]) for k in got)
    # with more items than windows the masks are the windows'
    more = bench.unionByName(spark.createDataFrame([(1000 + i, prose(5000 + i, 20 + i % 30)) for i in range(200)], "item_id long, text string"))
    some = {(x["id"], x["item_id"]): x["similarity"] for x in decontaminate.leaks(df.filter("doc_id < 12"), more).collect()}
    assert some == {k: v for k, v in got.items() if k[0] < 12} and len(some) > 3
    assert {x["doc_id"] for x in decontaminate.clean(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.clean(odd, bench.limit(0)).count() == 13 and decontaminate.clean(none, bench).count() == 0
    assert decontaminate.leaks(odd, spark.createDataFrame([(1, "MORE")], "item_id long, text string")).select("id").collect() == [(2,)]


def test_documents_shorter_than_an_item(spark):
    items = [(i, prose(700 + i, n)) for i, n in enumerate((5, 6, 15, 31, 59))]
    docs = []
    for i, text in items:
        w = text.split()
        docs += [(100 * i + cut, " ".join(w[:-cut])) for cut in range(1, min(len(w), 16))] + [(100 * i + 50 + cut, " ".join(w[cut:])) for cut in (1, 2, 4)]
    want = {}
    for d, text in docs:
        w = text.split()
        for i, item in items:
            b, n = bag(item), min(len(item.split()), len(w))
            of = lambda part: Counter(tuple(part[k : k + 5]) for k in range(len(part) - 4))
            best = max((overlap(of(w[s : s + n]), b) for s in range(len(w) - n + 1)), default=0)
            if best >= 0.8:
                want[d, i] = (best, len(w))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["id"], x["item_id"]): (x["similarity"], x["n"]) for x in decontaminate.leaks(df, bench).collect()}
    # a pair at the similarity itself may lie beyond the radius of the fingerprints
    assert got.keys() <= want.keys() and {k for k, (s, _) in want.items() if s > 0.85} <= got.keys() and (401, 4) in got
    assert all(got[k] == (pytest.approx(want[k][0]), want[k][1]) for k in got)
    assert 401 not in {x["doc_id"] for x in decontaminate.clean(df, bench).collect()}


def test_clean_with_clashing_columns(clashing, spark):
    bench = spark.createDataFrame([(1, prose(2, 40))], "item_id long, text string")
    assert sorted(str(x["doc_id"]) for x in decontaminate.clean(clashing, bench).collect()) == sorted(map(str, [3, 4, 5, None, None, 6, 7, 8, 8, 9]))


def test_blocks_find_all_prints_within_the_radius():
    r = random.Random(1)
    for _ in range(200):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << bit
        width = 64 // decontaminate.BLOCKS
        blocks = [((a ^ b) >> (i * width)) & ((1 << width) - 1) for i in range(decontaminate.BLOCKS)]
        assert any(x in decontaminate._MASKS for x in blocks)


# language


def test_languages_are_told_apart(spark, odd, none, clashing):
    r = random.Random(2)
    sets = {"xx": "abcde fghij", "yy": "éèàûô abcij", "zz": "opqrs tuvwx"}

    def text(lang, n):
        return " ".join("".join(r.choice(sets[lang]) for _ in range(6)) for _ in range(n))

    rows = [(i, text(lang, r.randint(5, 60)), lang, "a", 0) for i in range(400) for lang in [r.choice(list(sets))]]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("held_out", langid.held_out("doc_id"))
    model = langid.fit(df.filter("NOT held_out"))
    out = langid.predict(df, model).collect()
    held = [x for x in out if x["held_out"]]
    assert len(held) > 50 and np.mean([x["lang_pred"] == x["lang"] for x in held]) > 0.98
    assert all(0 <= x["score"] <= 1 for x in out) and np.mean([x["accepted"] for x in out]) > 0.95
    got = langid.predict(odd, model).collect()
    for x in got:
        assert (x["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", x["text"] or ""))
    assert langid.predict(none, model).count() == 0
    assert sorted(x["lang_pred"] for x in langid.predict(clashing, model).collect()) == sorted(x["lang_pred"] for x in got)
    assert langid.fit(none) is None and {x["lang_pred"] for x in langid.predict(odd, None).collect()} == {"und"}


def test_predictions_are_those_of_plain_python(spark, odd):
    """Scores from the model's table, one subword at a time; and they are calibrated on held-out rows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out("doc_id"))
    model = langid.fit(docs.filter("NOT held_out"))
    rows = langid.predict(docs, model).collect()

    def plain(text):
        data = text.encode()
        folded = [c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in data]
        shift = 32 - (langid.BUCKETS.bit_length() - 1)
        total, n = np.zeros(len(model.languages)), 0
        for size, odd_ in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
            for i in range(len(folded) - size + 1):
                gram = 0
                for c in folded[i : i + size]:
                    gram = gram << 8 | c
                total += model.table[((gram * odd_) & 0xFFFFFFFF) >> shift]
                n += 1
        logits = (total / max(n, 1) + model.bias) / model.temperature
        p = np.exp(logits - logits.max())
        return model.languages[int(p.argmax())], float(p.max() / p.sum())

    for x in [r for r in rows if r["text"] and re.search(r"[^\W\d_]", r["text"])][:40]:
        lang, score = plain(x["text"])
        assert x["lang_pred"] == lang and x["score"] == pytest.approx(score, abs=1e-3)
    held = [x for x in rows if x["held_out"] and x["lang"] and x["lang_pred"] != "und"]
    right = np.mean([x["lang_pred"] == x["lang"] for x in held])
    assert len(held) > 150 and right > 0.95 and abs(np.mean([x["score"] for x in held]) - right) < 0.05


def test_long_texts_in_slices_and_the_bound_of_languages(spark, odd, monkeypatch):
    """Slices that end within texts add up to the same scores; of many languages those with most rows are learnt."""
    rows = [(i, prose(i, 30) + (" éè" * 20 if i % 3 else ""), ("xx", "yy", "yy")[i % 3], "a", 0) for i in range(120)]
    df = spark.createDataFrame(rows, COLUMNS)
    model = langid.fit(df)
    both = df.unionByName(odd)
    whole = sorted((str(x["text"]), x["lang_pred"], x["score"]) for x in langid.predict(both, model).collect())
    monkeypatch.setattr(langid, "SLICE", 37)
    sliced = sorted((str(x["text"]), x["lang_pred"], x["score"]) for x in langid.predict(both, model).collect())
    assert [x[:2] for x in whole] == [x[:2] for x in sliced] and [x[2] for x in sliced] == pytest.approx([x[2] for x in whole], abs=1e-4)
    assert model.languages == ["xx", "yy"] and langid.fit(df, languages_at_most=1).languages == ["yy"]


# language model


def plain_scores(texts, order=3):
    """(words, score) of each text by plain Python, with counts of the other texts alone."""
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    words = [(t or "").split() for t in texts]
    whole = [Counter() for _ in range(order)]
    for w in words:
        for n in range(order):
            whole[n].update(grams(w, n + 1))
    all_words = sum(map(len, words))
    out = []
    for w in words:
        own = [grams(w, n + 1) for n in range(order)]
        count = lambda g: whole[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: E731, B023
        score = 0
        for i in range(len(w)):
            context, steps = tuple(w[max(0, i - order + 1) : i]), 0
            while context and not count((*context, w[i])):
                context, steps = context[1:], steps + 1
            if context:
                value = math.log(count((*context, w[i])) / count(context))
            else:
                value = math.log(max(count((w[i],)), lm.UNSEEN) / max(all_words - len(w), 1))
            score += value + steps * math.log(lm.BACKOFF)
        out.append((len(w), score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_by_stupid_backoff(spark, order, monkeypatch):
    """In one block for all and in many small ones."""
    r = random.Random(7)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(0, 40))) for _ in range(50)] + [None, " ", "é 😀"]
    docs = list(enumerate([*texts, texts[3]]))
    want = plain_scores([t for _, t in docs], order)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {x["id"]: x for x in lm.score(df, order=order).collect()}
    for i, (n, s) in enumerate(want):
        assert got[i]["n_words"] == n and got[i]["log_score"] == pytest.approx(s, abs=1e-4)
        assert got[i]["mean_log_score"] == (pytest.approx(s / n, abs=1e-4) if n else None)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_in_slices(spark, order, monkeypatch):
    """The slices add up to the scores in one go and to plain Python's; ids that repeat stay apart."""
    r = random.Random(8)
    texts = [" ".join(r.choice("abcdefgh") * r.choice([1, 1, 1, 2, 30]) + str(r.choice(["", "", r.random()])) for _ in range(r.randint(0, 40))) for _ in range(60)] + [None, "", "new", "a"]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    once = Counter(map(tuple, lm.score(df, order=order).collect()))
    monkeypatch.setattr(lm, "SLICE_WORDS", 1)
    sliced = Counter(map(tuple, lm.score(df, order=order).collect()))
    assert sliced == once
    want = sorted((i // 2, n, s) for i, (n, s) in enumerate(plain_scores(texts, order)))
    for got, (i, n, s) in zip(sorted(x[:3] for x in sliced.elements()), want, strict=True):
        assert got[:2] == (i, n) and got[2] == pytest.approx(s, abs=1e-4)
    assert not spark.catalog.listTables()


def test_scores_take_little_disk(spark, monkeypatch):
    """The shuffle files and tables that lie on disk at once, as n-grams of all orders took several times the text."""
    import threading
    from pathlib import Path

    r = random.Random(9)
    vocabulary = prose(5, 3000).split()
    texts = [" ".join(r.choices(vocabulary, k=400)) for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(lm, "SLICE_WORDS", 1, raising=False)
    context, done, seen = spark.sparkContext, threading.Event(), []
    context._jvm.System.gc()
    folders = [Path(str(x)) for x in context._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    tables = Path(context._jsc.sc().getCheckpointDir().get().removeprefix("file:"))

    def used() -> int:
        total = 0
        for p in [*(p for d in folders for p in d.rglob("shuffle_*.data")), *tables.rglob("*.parquet")]:
            try:
                total += p.stat().st_size if p.is_file() else 0
            except OSError:  # gone meanwhile
                pass
        return total

    done.wait(2)
    before = used()

    def watch() -> None:
        while not done.wait(0.05):
            seen.append(used() - before)

    thread = threading.Thread(target=watch)
    thread.start()
    rows = lm.score(df).collect()
    done.set()
    thread.join()
    assert len(rows) == len(texts)
    assert max(seen) < 3.5 * sum(map(len, texts))


def test_scores_in_many_parts(spark, monkeypatch):
    """Blocks that have nothing in a part, and parts of a few n-grams, don't change a score."""
    texts = [prose(i % 5, 30) + f" new{i} a b a b" for i in range(40)] + ["", "a b", "alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    monkeypatch.setattr(lm, "PART", 20)
    monkeypatch.setattr(lm, "SLICE_WORDS", 100)
    got = {x["id"]: x for x in lm.score(df).collect()}
    for i, (n, s) in enumerate(plain_scores(texts)):
        assert got[i]["n_words"] == n and got[i]["log_score"] == pytest.approx(s, abs=1e-4)


def test_hashes_are_sorted_stably():
    """Also where their high bits are the same, or all of them."""
    r = np.random.default_rng(1)
    for hashes in (r.integers(0, 1 << 63, 5000), r.integers(0, 50, 5000), np.repeat(r.integers(0, 1 << 63, 50), 100), np.zeros(0)):
        hashes = r.permutation(hashes).astype(np.uint64)
        assert (lm._by_hash(hashes) == np.argsort(hashes, kind="stable")).all()


def test_scores_shuffle_arrays(spark):
    """N-grams travel in arrays by block and part: a row for each took most of the time."""
    store = spark.sparkContext._jsc.sc().statusStore()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def stages() -> dict:
        stages = store.stageList(None, False, False, quantiles, spark.sparkContext._jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    vocabulary = prose(5, 500).split()
    r = random.Random(10)
    texts = [" ".join(r.choices(vocabulary, k=200)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    before = stages()
    assert len(lm.score(df).collect()) == len(texts)
    rows = sum(n for stage, n in stages().items() if stage not in before)
    assert 0 < rows < sum(len(t.split()) for t in texts) / 20


def test_scores_do_not_depend_on_blocks(spark):
    texts = [prose(i % 7, 30) for i in range(40)] + ["a b", "a b c a b", "", "a b d"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    once = {x["id"]: x["log_score"] for x in lm.score(df.coalesce(1)).collect()}
    many = {x["id"]: x["log_score"] for x in lm.score(df.repartition(13)).collect()}
    assert once == many and len(once) == len(texts)


def test_blocks_are_bounded(monkeypatch):
    batches = [pa.record_batch([pa.array(range(10)), pa.array(["x" * n for n in (5, 5, 50, 5, 5, 5, 0, 0, 5, 5)])], names=["id", "text"])] * 3

    class Task:
        def partitionId(self):
            return 2

    monkeypatch.setattr(lm.TaskContext, "get", classmethod(lambda cls: Task()))
    monkeypatch.setattr(lm, "BLOCK", 20)
    names = [b for x in lm._blocked(iter(batches)) for b in x.column(0).to_pylist()]
    sizes = [len(t) for x in batches for t in x.column(1).to_pylist()]
    by = {}
    for name, size in zip(names, sizes, strict=True):
        by.setdefault(name, []).append(size)
    assert names == sorted(names) and all(n >> 32 == 2 for n in names)
    assert all(sum(x) <= 20 or len(x) == 1 for x in by.values())


def test_scores_of_odd_tables(odd, none, clashing):
    assert lm.score(none).count() == 0
    rows = lm.score(odd).collect()
    assert len(rows) == 13 and {x["mean_log_score"] for x in rows if not x["n_words"]} == {None}
    assert sorted(x["log_score"] for x in rows) == sorted(x["log_score"] for x in lm.score(clashing).collect())


# pipeline


def test_pipeline_stages_take_odd_tables(spark, odd, none, tiny):
    import corpus_pipeline

    for docs in (odd, none):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, tiny)
            assert set(corpus_pipeline.COLUMNS) <= set(out.columns)
            assert i == 4 or out.columns == list(corpus_pipeline.COLUMNS)
            assert out.count() <= docs.count()


def test_pipeline_keeps_clean_documents(spark, tiny):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    good = docs.join(spark.read.parquet(f"{tiny}/labels.parquet").filter("quality = 1"), "doc_id").select(docs.columns)
    long_enough = {x["doc_id"] for x in good.collect() if counts(x["text"])[0] >= 50 and 2 * counts(x["text"])[4] <= counts(x["text"])[0]}
    kept = {x["doc_id"] for x in corpus_pipeline.quality_rules(spark, docs, tiny).collect()}
    assert long_enough <= kept
    deduped = corpus_pipeline.near_duplicates(spark, docs, tiny)
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    assert {x["doc_id"] for x in deduped.collect()} == set(classes_of(rows))
    clean = {x["doc_id"] for x in corpus_pipeline.benchmark_leaks(spark, docs, tiny).collect()}
    items = [x["text"] for x in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    assert {d for d, t in rows if not any(i in t for i in items)} == clean
    scanned = corpus_pipeline.secret_scan(spark, docs, tiny)
    assert scanned.count() == len(rows) and scanned.filter(F.col("text").rlike("AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}")).count() == 0


def test_pipeline_end_to_end_takes_repeated_ids_and_clashing_columns(spark, tmp_path, tiny):
    """Every stage's decision holds in the result; different texts of one id or none all stay."""
    import shutil

    import corpus_pipeline

    leak = spark.read.parquet(f"{tiny}/benchmark.parquet").first()["text"]
    good = [(None if i % 3 == 0 else 7, prose(300 + i, 90), "en", "s", 1) for i in range(12)]
    secret = prose(400, 80) + " password=abcdefabcdefabcdef0 " + prose(401, 20)
    bad = [(20, prose(500, 10), "en", "s", 1), (21, prose(501, 60) + " " + leak, "en", "s", 1), (22, good[0][1] + " more", "en", "s", 1), (23, None, None, None, None)]
    rows = [*good, (30, secret, "en", "s", 1), *bad]
    spark.createDataFrame(rows, COLUMNS).withColumn("__key", F.lit("x")).withColumn("class_id", F.lit("y")).write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(f"{tiny}/benchmark.parquet", tmp_path / "benchmark.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).select(*corpus_pipeline.COLUMNS)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS), i
    texts = Counter(x["text"] for x in docs.collect())
    assert set(texts.values()) == {1}
    near = {good[0][1], bad[2][1]}
    assert len(near & set(texts)) == 1 and {t for _, t, *_ in good[1:]} <= set(texts)
    assert secret.replace("password=abcdefabcdefabcdef0", "[SECRET]") in texts and not {bad[0][1], bad[1][1], None} & set(texts)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["text"] for x in out} <= set(texts) and sum(x["taken"] for x in out) > 0


@pytest.mark.parametrize("name", ["op1_secret_scan", "op2_decontaminate", "op3_language_id", "op4_chat_format", "op5_license_scan", "op6_quality_rules", "op7_mix_to_weights", "op8_minhash_near_dedup", "op9_lm_score", "op10_url_filter"])
def test_queries_and_their_sql(spark, tiny, name):
    from pulsefold.llm import queries

    df = queries.QUERIES[name](spark, tiny)
    rows = df.collect()
    tables = {"op4_chat_format": "conversations", "op10_url_filter": "pages"}
    if name not in ("op2_decontaminate", "op4_chat_format"):
        assert len(rows) == spark.read.parquet(f"{tiny}/{tables.get(name, 'documents')}.parquet").count()
    if name in queries.ORACLES:
        duckdb = pytest.importorskip("duckdb")
        connection = duckdb.connect()
        for t in ("documents", "pages", "conversations", "benchmark"):
            connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
        result = connection.execute(queries.ORACLES[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        want = Counter(repr(tuple(r[columns.index(c)] for c in df.columns)) for r in result.fetchall())
        assert Counter(repr(tuple(r)) for r in rows) == want
