"""Operators against plain versions that compare everything with everything."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from textscan.llm import chat, decontamination, packing, pii, quality_gam, quality_rules, simhash, substring_dedup, token_count
from textscan.llm.queries import QUERIES, tokenizer_path

DATA = "/root/testdata/sf0.001"
RANDOM = random.Random(5)


def words(n, vocabulary=400, rng=RANDOM):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").toPandas()


# --- personal data


def base_by_regex(text):
    """The base kinds straight from their patterns."""
    out = {"email": [], "ip": [], "card": [], "phone": []}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out["phone"].append(m.span())
    return [(k, *s) for k, v in out.items() for s in v]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab.@+-_ 0123456789()\nÄ%:/٣", max_size=60))
def test_base_spans_equal_patterns(text):
    assert [s for s in pii.find(text) if s[0] in pii.BASE] == base_by_regex(text)


def test_base_spans_of_joined_pieces():
    rng = random.Random(3)
    parts = ["a.b@c.de", "x@y", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (243) 555-5526", "+49", ".", "@", " ", "-", "5", "é"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert [s for s in pii.find(text) if s[0] in pii.BASE] == base_by_regex(text), text


def test_further_kinds_and_redaction():
    text = 'See https://bob:pw1@host.example/x, token = "f3ef4d6b2755a36d7d9c25bd" IBAN: DE89 3704 0044 0532 0130 00 SSN 123-45-6789 or a@b.co.'
    found = {k: text[a:b] for k, a, b in pii.find(text)}
    assert found["login"] == "bob:pw1" and found["secret"].startswith("f3ef") and found["iban"].startswith("DE89") and found["ssn"] == "123-45-6789"
    cleaned = pii.redact(text)
    assert "[EMAIL]" in cleaned and not pii.find(cleaned)
    assert pii.redact("plain") == "plain" and pii.redact(None) is None


# --- tokens


def test_cues_inside_a_secret_are_part_of_it():
    text = "token=" * 60_000 + "end"
    assert [k for k, *_ in pii.find(text)] == ["secret"] and pii.redact(text) == "token=[SECRET]"
    assert [s for s in pii.find("secret: " + "a" * 16 + " token=" + "b" * 16) if s[0] == "secret"] == [("secret", 8, 24), ("secret", 31, 47)]


def test_token_counts_equal_library():
    path = tokenizer_path("byte_bpe_50k.json")
    texts = [None, "", " ", "\n\n  a", "Hello  world\r\n\tx", "it's we'll 'sx", "<|endoftext|> b<|endoftext|>", "日本語 text", "a b", "éx y", "\x1c\x1d a", "🙂🙂 ok", "x" * 5000, " " * 3000]
    rng = random.Random(1)
    texts += ["".join(rng.choice(["the", " of", "Zq", "'s", " 12", "½", "é", "\n", "  ", "!?", "²", "ß", "\x85", "٣"]) for _ in range(rng.randrange(30))) for _ in range(500)]
    want = [len(e.ids) for e in token_count.tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert token_count.Counter(path).counts(texts) == want
    assert len(token_count.whole_tokens(path)) > 40_000


def test_token_count_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_count, "CACHE", 3)
    counter = token_count.Counter(tokenizer_path("byte_bpe_50k.json"))
    assert [counter.counts([t])[0] for t in ("zqxj vkwq", "qqzzj xxkw pwqz zzqk", "zqxj vkwq")][0::2] == counter.counts(["zqxj vkwq"]) * 2
    assert len(counter.known) - counter.proved <= 3 + 4


def test_word_ids_equal_library():
    path = tokenizer_path("word_bpe_49k.json")
    texts = [None, "", "Of the, AND.", "Straße, étoile. ÉTÉ,", "a b\x1cc\x85d", "it's 1,000.50", "<|endoftext|>x <|startoftext|>", "ΣΑΣ ς", "İx", "é.", "...", ",", "x" * 3000]
    rng = random.Random(2)
    texts += ["".join(rng.choice(["The", "of,", " ", "Zq.", "'s", "12", "é", "\n", "\t", "İ", "K"]) for _ in range(rng.randrange(25))) for _ in range(500)]
    want = [np.array(e.ids, "<u4").tobytes() for e in token_count.tokenizer(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert packing.WordIds(path).ids(texts) == want


# --- SimHash


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    for text in [None, "", " \n", "One", "one two", "A b c", "a b c d É", words(300), "x " * 1000, "a b c\x1cd e"]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("chunk", [4096, 7])
def test_close_pairs_and_components(spark, chunk):
    rng = random.Random(8)
    fps = {0, 1, 1 << 63}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 40])):
            fps.add(base)
            for b in rng.sample(range(64), rng.randrange(5)):
                base ^= 1 << b
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = simhash.close_pairs(df, chunk=chunk)
    rows = [(r["a"], r["b"]) for r in links.collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 3 for a, b in rows)
    want = roots_of(fps, lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 3)
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert {n: got.get(n, n) for n in fps} == want


def test_components_of_a_chain(spark):
    order = list(range(60))
    random.Random(4).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert got == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100}
    assert simhash.components(links.limit(0)).count() == 0


def test_simhash_query(spark):
    docs = documents(spark)
    fp = {d: slow_fingerprint(t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    roots = roots_of(sorted(fp), lambda a, b: bin(fp[a] ^ fp[b]).count("1") <= 3)
    rows = QUERIES["op6_simhash"](spark, DATA).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {(d, f"{fp[d]:016x}", roots[d]) for d in fp}
    kept = simhash.drop_near_duplicates(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id", "text")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots.values()))


# --- decontamination


def slow_hits(text, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    w, hit, found = cut(text), set(), set()
    for item, t in items:
        v = cut(t)
        for i in range(max(1, len(v) - 9) if v else 0):
            g = v[i : i + 10]
            for at in range(len(w) - len(g) + 1):
                if w[at : at + len(g)] == g:
                    hit.update(range(at, at + len(g)))
                    found.add(item)
    return len(w), hit, found


def test_matcher_against_plain_search():
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice(["a", "b", "of", "the", "É", "x1", "longerword"]) for _ in range(n))
    items = [(str(i), say(rng.choice([1, 2, 3, 5, 9, 10, 11, 14]))) for i in range(25)] + [("e", ""), ("n", None), ("z", "The OF, the-of")]
    texts = [say(rng.randrange(60)) for _ in range(60)] + [items[i][1] for i in range(20)] + [None, "", "...", "prefix" + items[0][1], items[3][1].upper() + "!" + items[4][1]]
    matcher = decontamination.Matcher([x for x in items if x[1]])
    got = matcher.search(texts)
    assert got == [slow_hits(t, items) for t in texts]
    assert decontamination.Matcher([]).search(texts)[0][1:] == (set(), set())


def test_long_text_and_several_passes(spark, monkeypatch):
    rng = random.Random(7)
    items = [(i, words(30, 3000, rng)) for i in range(12)]
    text = " ".join(words(2000, 3000, rng) + " " + t for _, t in items)
    docs = spark.createDataFrame([(1, text), (2, words(500, 3000, rng)), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (None, words(20)), (99, None)], "item_id long, text string")
    one = decontamination.contamination(docs, "text", bench, "item_id", "text").collect()
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 1500)
    assert decontamination.contamination(docs, "text", bench, "item_id", "text").collect() == one
    assert [r["n_hit"] for r in one] == [360, 0, 0] and len(one[0]["item_ids"]) == 12


# --- quality


def slow_measure(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    repeated = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), len(lines)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t|#\x0b\x1c é", max_size=80))
def test_measures(text):
    assert quality_rules.measure(text) == slow_measure(text)


def test_many_groups_are_joined_by_hash(spark):
    plain = "It was there and of the other one so that nobody minded it at all"
    rows = [(i, plain + (" $$$$" * 9 if i % 20 == 0 else ""), "en" if i % 2 else None, f"s{i % 4}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    few = sorted(r["doc_id"] for r in quality_rules.quality_filter(df, "text", "lang", "source").collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = sorted(r["doc_id"] for r in quality_rules.quality_filter(df, "text", "lang", "source").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert few == many == [i for i in range(400) if i % 20]


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = np.zeros((4000, len(quality_gam.FEATURES)))
    x[:, :2] = rng.uniform(size=(4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.train(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert quality_gam.train(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3


def test_gam_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in QUERIES["op3_quality_gam"](spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([s for s, y, _ in rows if y == v] for v in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(bad) > 50 and auc > 0.97
    assert np.mean([p == y for _, y, p in rows]) > 0.95


# --- repeated passages


def test_repeats_are_removed_once(spark):
    rng = random.Random(9)
    sentence = lambda n: (words(n, 5000, rng) + ".").capitalize()
    shared = " ".join(sentence(rng.randrange(4, 14)) for _ in range(8))
    unpunctuated = words(120, 5000, rng)
    own = [" ".join(sentence(8) for _ in range(6)) for _ in range(6)]
    texts = [own[0] + " " + shared, own[1] + " " + shared.upper() + "\n" + own[2], own[3], own[3], own[4] + " " + unpunctuated, unpunctuated + "\n" + own[5], None, "", "Short. One."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in substring_dedup.remove_repeats(df, "doc_id", "text").collect()}
    assert [out[i]["n_removed"] > 0 for i in range(9)] == [False, True, False, True, False, True, False, False, False]
    assert out[1]["text"].split() == (own[1] + " " + own[2]).split() and out[3]["text"] == ""
    assert len(out[5]["text"].split()) < len(texts[5].split()) - 60
    assert all(out[i]["text"] == texts[i] for i in (0, 2, 4, 6, 7, 8))
    assert _removed_by_plain_search(texts) == {i: r["n_removed"] for i, r in out.items()}


def plain_units(text):
    """The words of each sentence, those of long sentences cut behind the least word of each six, word by word."""
    parts = (text or "").split()
    low = (text or "").lower().split()
    lines = re.split("\n", text or "")
    ends, at = set(), 0
    for line in lines:
        at += len(line.split())
        ends.add(at - 1)
    ends |= {i for i, w in enumerate(parts) if w[-1] in ".!?"}
    ends.add(len(low) - 1)

    def rank(word):
        return sum(ord(c) * (ord(c) ^ 0x85EBCA6B) for c in word) % 2**32 * 0x9E3779B1 % 2**32

    ranks = [rank(w) for w in low]
    least = set()
    for i in range(len(low) - 5):
        least.add(max(range(i, i + 6), key=lambda k: (-ranks[k], k)))
    units, begin = [], 0
    for end in sorted(e for e in ends if 0 <= e < len(low)):
        inner = [k for k in range(begin, end) if k in least] if end + 1 - begin > 16 else []
        for a, b in zip([begin - 1, *inner], [*inner, end], strict=True):
            units.append(tuple(low[a + 1 : b + 1]))
        begin = end + 1
    return units


def plain_runs(units):
    """(first unit, units) from each unit on: three or more with twenty words or more."""
    for i in range(len(units)):
        for n in range(3, len(units) - i + 1):
            if sum(map(len, units[i : i + n])) >= 20:
                yield i, tuple(units[i : i + n])
                break


def _removed_by_plain_search(texts):
    """Row -> number of sentences that a later occurrence of any run covers."""
    first, gone = {}, defaultdict(set)
    for i, t in enumerate(texts):
        for at, run in plain_runs(plain_units(t)):
            if first.setdefault(run, (i, at)) != (i, at):
                gone[i].update(range(at, at + len(run)))
    return {i: len(gone[i]) for i in range(len(texts))}


def test_plain_units_are_the_sentences():
    texts = [t for t in open(__file__).read().split("def ")] + ["Ünï SS ẞtraße. İstanbul! a\nb " * 9, "", " \n ", "x " * 300]
    for t in texts:
        assert [len(u) for u in plain_units(t)] == [u[3] for u in substring_dedup.sentences(t)]


@pytest.mark.parametrize("together", [1 << 14, 3, 1])
def test_hot_and_other_runs_give_the_same(spark, monkeypatch, together):
    """Repeats told among all texts of a task, among some, only in the shuffle."""
    rng = random.Random(3)
    sentence = lambda: (words(rng.randrange(6, 12), 5000, rng) + ".").capitalize()
    passage = lambda n: " ".join(sentence() for _ in range(n))
    common, rare = passage(5), [passage(4) for _ in range(10)]
    texts = [" ".join([passage(3), *([common] if i % 2 else []), *([rare[i // 4]] if i % 4 < 2 else []), passage(2)]) for i in range(40)]
    monkeypatch.setattr(substring_dedup, "TOGETHER", together)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(df, "doc_id", "text").collect()}
    assert out == _removed_by_plain_search(texts) and sum(out.values()) > 100


@pytest.mark.parametrize("size", [51, 60])
def test_passages_of_51_words_are_found_wherever_they_stand(size):
    """In an unpunctuated line, between other words, against a plain search for words that stand in the first text."""
    rng = random.Random(15)
    for offset in range(0, 120):
        passage = words(size, 5000, rng)
        first, second = (f"{words(n, 5000, rng)} {passage} {words(40, 5000, rng)}" for n in (30, 20 + offset))
        seen = {h for _, _, h in substring_dedup.runs(substring_dedup.sentences(first))}
        units = substring_dedup.sentences(second)
        gone = {u for at, n, h in substring_dedup.runs(units) if h in seen for u in range(at, at + n)}
        assert sum(units[u][3] for u in gone) >= size - 4 * substring_dedup.WINDOW
        one, two = first.split(), second.split()
        known = {tuple(one[i : i + 20]) for i in range(len(one) - 19)}
        plain = {i + k for i in range(len(two) - 19) if tuple(two[i : i + 20]) in known for k in range(20)}
        places = np.cumsum([0, *(u[3] for u in units)])
        assert {w for u in gone for w in range(places[u], places[u + 1])} <= plain


def test_pieces_of_long_sentences_are_short():
    assert max(u[3] for u in substring_dedup.sentences(words(5000, 9, random.Random(16)))) <= substring_dedup.WINDOW
    assert len(substring_dedup.sentences("same " * 17)) > 1


@pytest.mark.parametrize("key", [7, None])
def test_rows_of_one_id_are_judged_on_their_own(spark, key):
    rng = random.Random(14)
    sentence = lambda: (words(9, 5000, rng) + ".").capitalize()
    passage = lambda n: " ".join(sentence() for _ in range(n))
    shared, head, own = passage(4), passage(5), passage(12)
    texts = [shared, head + " " + shared, own, "Short. One.", None, head]
    df = spark.createDataFrame([(key, t) for t in texts], "doc_id long, text string").coalesce(1)
    got = [(r["text"], r["n_removed"]) for r in substring_dedup.remove_repeats(df, "doc_id", "text").collect()]
    assert Counter(got) == Counter([(shared, 0), (head + " ", 4), (own, 0), ("Short. One.", 0), (None, 0), ("", 5)])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n\té", max_size=200))
def test_sentences_cover_the_text(text):
    units = substring_dedup.sentences(text)
    assert all(a < b for a, b, _, _ in units)
    assert sum(u[3] for u in units) == len(text.split())
    assert "".join(text[a:b] for a, b, _, _ in units).split() == text.split()


# --- packing


def test_packing_query(spark):
    path = tokenizer_path("word_bpe_49k.json")
    docs = documents(spark)
    ids = {d: np.array([*e.ids, 1], "<u4") for d, e in zip(docs.doc_id, token_count.tokenizer(path).encode_batch(list(docs.text), add_special_tokens=False), strict=True)}
    rows = QUERIES["op9_packing"](spark, DATA).collect()
    check_packing(rows, ids, 2048)
    used = defaultdict(int)
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert sum(used.values()) / (2048 * len(used)) > 0.97


def test_repeated_rows_are_packed_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    df = spark.createDataFrame([(7, "the same text")] * 400 + [(None, None)] * 400, "doc_id long, text string")
    rows = packing.pack(df, "doc_id", "text", tokenizer_path("word_bpe_49k.json")).collect()
    sizes = Counter(r["sequence_id"] >> 32 for r in rows)
    assert len(rows) == 800 and len(sizes) == 16 and max(sizes.values()) < 100


def check_packing(rows, ids, window):
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and len(ids[r["doc_id"]]) == r["doc_tokens"] and len(piece) == r["length"] > 0
        covered[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, x in ids.items():
        assert sum(n for _, n in covered[d]) == len(x) and len({s for s, _ in covered[d]}) == len(covered[d])
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= window


def test_least_squares_against_projected_gradient():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.integers(0, 3, (8, 15)).astype(float), rng.uniform(0, 9, 8)
        x = packing.non_negative_least_squares(a, b)
        y = np.zeros(15)
        for _ in range(20000):
            y = np.maximum(0, y - a.T @ (a @ y - b) / (np.linalg.norm(a, 2) ** 2 + 1e-9))
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= np.linalg.norm(a @ y - b) + 1e-4


def test_plan_fills_windows():
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.geometric(1 / 600, 8000), 2047)
    shares = packing.plan(dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True)), strict=True)))
    sequence, offset = packing.pack_group(lengths, shares)
    used = np.bincount(sequence, lengths)
    assert used.max() <= 2048 and lengths.sum() / (2048 * len(used)) > 0.985


# --- chat


@settings(max_examples=500, deadline=None)
@given(st.sampled_from(["user", "assistant", "system", "tool", "a\"[/ROLE]<s>", None, ""]), st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE", "\\", "<", "[", "/", " ", "a", "\n", "s>", "INST]"]), max_size=12))
def test_turns_read_back(role, parts):
    text = "".join(parts)
    turn, a, b = chat.render(role, text)
    assert chat.parse(turn) == (role, text)
    assert chat.unescape(chat.escape(text)) == text
    assert not re.search(r"<s>|</s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\b", chat.escape(text))
    assert (chat.unescape(turn[a:b]) == text) if role == "assistant" else a == b == 0


def test_event_log_folds(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "Hel"), (1, 2, 1, "delta", None, "lo"), (1, 3, 0, "edit", None, "hi!"),
        (1, 4, 1, "regenerate", None, None), (1, 5, 1, "delta", None, "Good "), (1, 6, 1, "delta", None, "day"), (1, 7, 2, "message", "user", "x"), (1, 8, 2, "retract", None, None),
        (2, 0, 0, "edit", "system", "late"), (2, 1, 5, "regenerate", None, None), (2, 2, 6, "other", "user", "?"), (None, 0, 0, "message", None, None),
    ]
    df = spark.createDataFrame(random.Random(1).sample(log, len(log)), "conv long, seq long, message long, event string, role string, text string")
    got = {(r["conv"], r["message"]): chat.parse(r["turn"]) for r in chat.format_log(df).collect()}
    assert got == {(1, 0): ("user", "hi!"), (1, 1): ("assistant", "Good day"), (2, 0): ("system", "late"), (None, 0): (None, "")}


def test_long_conversation_keeps_its_order(spark):
    rows = [(5, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "conv_id long, turn long, role string, text string")
    (r,) = chat.digests(chat.format_log(chat.conversation_events(df))).collect()
    assert r["n_turns"] == 3000
    assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in rows).encode()).hexdigest()
    assert r["loss_sha256"] == hashlib.sha256("".join(x[3] for x in rows if x[1] % 2).encode()).hexdigest()
