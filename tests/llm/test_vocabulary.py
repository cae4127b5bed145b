"""Token files, spelling variants and divergence of sources against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pulsefold.llm import divergence, kernels, packed, spelling, terms

from .conftest import COLUMNS, prose

TOKENIZER = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path(TOKENIZER)


# token files


def test_codes_go_back_to_ranks():
    r = random.Random(5)
    edges = [0, 1, 254, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1]
    for _ in range(60):
        counts = np.array([r.choice([0, 1, 2, 3, 4, 5, 9]) for _ in range(r.randint(0, 12))], np.int64)
        ranks = np.array([r.choice(edges) for _ in range(int(counts.sum()))], np.uint32)
        control, data, n_control, n_data = packed.packed(ranks, counts)
        assert (n_control == (counts + 3) // 4).all() and n_control.sum() == len(control) and n_data.sum() == len(data)
        assert len(data) == sum(max(1, (int(x).bit_length() + 7) // 8) for x in ranks)
        assert (packed.unpacked(control, data, counts) == ranks).all()


def test_pieces_give_the_ids_of_whole_texts(path):
    r = random.Random(6)
    parts = ["it's", "we'RE", "'s", "'", "''ll", "don't,", "a1b22c", "12", "x=3;", "...", "é", "é", "́", " ", " ", "\x85", "😀ab", "ÀB", "İx", "ſt", "\x00", "日本 語", "#", "</w>", "Å1", "²3", "\t", "\n", "<|", "|>", "-foo-bar"]
    own = packed.Encoder(path)
    assert own.by_piece
    plain = ["".join(r.choice([*parts, " ", " ", "word", "And"]) for _ in range(r.randint(0, 25))) for _ in range(400)]
    for texts in (plain, [*plain[:20], "a<|endoftext|>b's <|startoftext|>", "<|ENDOFTEXT|>"], [None, "", " "]):
        for first, last, t in kernels.texts_of(pa.array(texts, pa.string())):
            ids, counts = own.texts(t)
            want = [own.tokenizer.encode(x or "", add_special_tokens=False).ids for x in texts[first:last]]
            assert counts.tolist() == list(map(len, want))
            assert ids.tolist() == [i for x in want for i in x]


def _ids_of(own, texts):
    for first, last, t in kernels.texts_of(pa.array(texts)):
        ids, counts = own.texts(t)
        want = [own.tokenizer.encode(x, add_special_tokens=False).ids for x in texts[first:last]]
        assert counts.tolist() == list(map(len, want))
        assert ids.tolist() == [i for x in want for i in x]


def test_words_of_letters_are_encoded_once_and_without_offsets(path, monkeypatch):
    own = packed.Encoder(path)
    monkeypatch.setattr(own, "_by_offset", lambda part: pytest.fail(f"offsets of {part}"))
    _ids_of(own, ["The the THE tHe", "the für Größe größe", "ÄRGER ärger naïveté þÿß Größe Ωμέγα слово", "The"])
    # A-Z are lower-cased first, unless what follows may compose with them
    assert set(own.known) == {"the", "für", "größe", "Ärger", "ärger", "naïveté", "þÿß", "Ωμέγα", "слово"}


def test_capitals_that_compose_otherwise_than_their_small_letters(path):
    marks = ["\u0331", "\u030c", "\u0308", "\u030a", "\u0307", "\u0301", "\u0327"]
    _ids_of(packed.Encoder(path), [f"{a}{m} x{a}{m}{a}x {a}" for a in "AHIJKTWYZ" for m in marks] + ["ÀA AÀ", "A", "ΑΣ ΣΑΣ", "<|ENDOFTEXT|>", "ÉA\u0301A"])


def test_pieces_that_most_chunks_have_are_kept(path, monkeypatch):
    monkeypatch.setattr(packed, "PIECES", 40)
    own, learnt = packed.Encoder(path), []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda new: (learnt.extend(new), learn(new)))
    for i in range(30):
        _ids_of(own, [f"often again a{i}b " + prose(i, 25), "often, 12 " + chr(ord("a") + i % 26) * 3])
        assert len(own.known) == len(own.at) - 1 == len(own.seen) <= 40 and own.at[-1] == len(own.flat)
    assert learnt.count("often") == learnt.count("again") == 1 and len(learnt) > 60


@pytest.mark.parametrize("shard_ids", [packed.SHARD_IDS, 100])
def test_files_hold_every_document_in_order(spark, odd, none, clashing, path, shard_ids):
    tokenizer = packed.Encoder(path).tokenizer
    for df in (odd, clashing):
        done = packed.write(df, path, end_id=2, shard_ids=shard_ids)
        rows = sorted(packed.read(spark, done.folder, with_ids=True).collect(), key=lambda r: r["start"])
        want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in odd.collect())
        assert [(r["id"] is not None, r["id"] or 0) for r in rows] == [w[0] for w in want]
        assert sorted(((r["id"] is not None, r["id"] or 0), r["ids"]) for r in rows) == want
        at = 0
        for r in rows:
            assert (r["start"], r["n"], r["ids_crc32"]) == (at, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes()))
            at += r["n"]
        assert (done.n_ids, done.n_documents) == (at, len(rows))
    empty = packed.write(none, path, end_id=2)
    assert packed.read(spark, empty.folder).count() == empty.n_documents == 0


def test_frequent_ids_are_short(spark, path):
    done = packed.write(spark.createDataFrame([(i, "the " * 300 + prose(i, 5), None, None, 0) for i in range(20)], COLUMNS), path, end_id=2)
    size = sum(r["length"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{done.folder}/shards").select("length").collect())
    assert size < 1.4 * done.n_ids + 20 * 200


# letters


def test_runs_of_letters():
    r = random.Random(7)
    texts = ["".join(r.choice("abZ é¿ÀÿĀ日-1×Ã") for _ in range(r.randint(0, 30))) for _ in range(200)]
    for pattern, letter in ((r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", terms.wide_letters), (r"[A-Za-zÀ-ÿ]+", terms.latin_letters)):
        for first, last, t in kernels.texts_of(pa.array(texts)):
            doc, found = terms.runs(t.data, t.bounds, letter(t.data))
            own = [(i - first, re.sub("[A-Z]", lambda m: m[0].lower(), w)) for i in range(first, last) for w in re.findall(pattern, texts[i])]
            assert list(zip(doc.tolist(), found.to_pylist(), strict=True)) == own


# spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_pairs_of_a_forest():
    r = random.Random(8)
    for alphabet in ("ab", "abcé😀"):
        words = sorted({(r.randint(0, 2), "".join(r.choice(alphabet) for _ in range(r.randint(0, 7)))) for _ in range(250)})
        keys = [w for _, w in words]
        length = np.array(list(map(len, keys)))
        u, v = spelling.near_in(np.array([b for b, _ in words]), np.frombuffer("".join(keys).encode("utf-32-le"), np.uint32), np.cumsum(length) - length, length)
        got = [frozenset((words[a], words[b])) for a, b in zip(u, v, strict=True)]
        want = {frozenset((x, y)) for i, x in enumerate(words) for y in words[:i] if x[0] == y[0] and near(x[1], y[1])}
        assert len(got) == len(set(got)) and set(got) == want


def spelled(rows, factor=10):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}
    keys = defaultdict(set)
    for w in n:
        for k in [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))]:
            keys[k].add(w)
    out, form = {}, {}
    for w in n:
        own = {x for k in [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))] for x in keys[k] if near(w, x)}
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= factor * n[w] else None
        out[w] = len(own)
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return rows


@pytest.mark.parametrize("limit", [spelling.SUBTREE, 6])
def test_variants_equal_the_plain_search(spark, limit):
    r = random.Random(9)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randint(7, 12))) for _ in range(60)] + ["prefixaa", "prefixab", "prefixaab", "prefixaaa", "prefixa", "aaaaaaaa", "aaaaaaa", "aaaaaaaaa"]
    texts = []
    for i in range(150):
        words = []
        for _ in range(120):
            w = base[min(int(r.expovariate(0.12)), len(base) - 1)]
            if r.random() < 0.1:
                k = r.randrange(len(w))
                w = w[:k] + r.choice(["", "x", w[k] + "y"]) + w[k + 1 :]
            words.append(w.upper() if r.random() < 0.1 else w)
        texts.append((None if i == 3 else i, " ".join(words) if i != 4 else None))
    texts += [(1000 + i, "ggbbccdd " * 200 + "ggbbccde " * 15 + "ggbbccee ") for i in range(10)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {tuple(x) for x in spelling.variants(df, limit=limit).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = spelled(texts)
    assert got == want
    assert sum(x[1] is not None for x in want) > 20 and any(x[2] not in (x[0], x[1]) for x in want)


def test_variants_of_odd_rows(odd, odd_rows, none, clashing):
    want = spelled([(r[0], r[1]) for r in odd_rows])
    for df in (odd, clashing):
        assert {tuple(x) for x in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()} == want
    assert spelling.variants(none).count() == 0


# divergence


def diverged(rows, least, top):
    documents, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        own = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        documents[lang].update(set(own))
        count[lang, source].update(own)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in documents[lang].items() if n >= least)
        p = {}
        for s in [*sources, None]:
            c = [count[lang, s][t] if s is not None else sum(count[lang, x][t] for x in sources) for t in kept]
            p[s] = [1 + 10**9 * (x + 5) // (sum(c) + 5 * len(kept)) for x in c]
        for s in sources:
            pairs = sorted(((-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode()) for o in sources if o != s))
            far = sorted((q - a, t.encode()) for t, a, q in zip(kept, p[s], p[None], strict=True) if count[lang, s][t] and a > q)[:top]
            for part, found in (("pair", pairs), ("term", far)):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)}
    return out


@pytest.mark.parametrize(("chunk", "top"), [(divergence.CHUNK, 50), (3, 4)])
def test_divergence_equals_plain_counts(spark, chunk, top):
    r = random.Random(10)
    words = ["été", "Zoo", "a", "b", "ça", "the", "ox", "日本", "quail", "zz"]
    rows = [(" ".join(r.choice(words[: 4 + i % 7]) for _ in range(r.randint(0, 20))), r.choice(["en", "fr", None, "x"]), r.choice(["s1", "s2", "é", None])) for i in range(300)]
    rows += [("", "zu", "only"), (None, "zu", "other"), ("one", "single", "group")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    got = {tuple(x) for x in divergence.audit(df, least=30, top=top, chunk=chunk).collect()}
    assert got == diverged(rows, 30, top)
    assert len(got) > 40


def test_divergence_of_odd_rows(odd, odd_rows, none, clashing):
    want = diverged([r[1:4] for r in odd_rows], 2, 50)
    for df in (odd, clashing):
        assert {tuple(x) for x in divergence.audit(df, least=2).collect()} == want
    assert divergence.audit(none).count() == 0


def test_long_division_is_exact():
    r = random.Random(11)
    totals = [r.randint(10, 9 * 10**15) for _ in range(300)]
    counts = [r.randint(0, t) for t in totals]
    got = divergence._p(np.array(counts), np.array(totals))
    assert got.tolist() == [1 + 10**9 * c // t for c, t in zip(counts, totals, strict=True)]

