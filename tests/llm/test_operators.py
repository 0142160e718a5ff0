"""The corpus operators against brute force on small tables, with the odd rows every one of them must take."""

import hashlib
import ipaddress
import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from faultline.llm import mixing, packing, pii, quality, rangecoder, simhash, substrings, token_files, tokens, toxicity, urls, vptree
from faultline.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")
KIND = "doc_id long, text string, lang string, source string, n_chars long, fp string, n int, row int, key string, h long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sample():
    r = random.Random(3)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(60, 200))) for _ in range(20)]
    texts[5] = texts[2]
    texts[6] = texts[2] + " omega"
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(30, None, None, None), (31, "", "en", "s0"), (32, " \n ", "en", None), (33, "x\0y é 𝄞 " * 30000, "en", "s1")]
    rows += [rows[4], rows[4], (None, texts[7], None, "s2"), (None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None, "a", 1, 2, "k", 3) for r in sample()], KIND)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def brute_quality(text):
    words = [w.decode() for w in (text or "").encode().split()]
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(wins)
    covered = {j for i, w in enumerate(wins) if many[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, none):
    rows = sample() + [(50, "a b a b a b\na b a b a b\n#|<\u00a0x>", "en", "q"), (51, "x y z\tx y z w\nx y z", "en", "q")]
    rows = [r for r in rows if r[0] != 33] + [(33, "For For For For\n" * 400, "en", "q")]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    want = Counter((r[0], *brute_quality(r[1])) for r in rows)
    assert Counter((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got) == want
    assert all(g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words) for g in got)
    assert quality.judge(none).count() == 0


def test_frequent_lines_are_removed_and_depleted_documents_go(spark):
    r = random.Random(1)
    fresh = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 10**6)) for _ in range(n))
    menu = " ".join(f"menu{i}" for i in range(60))
    rows = [(i, f"{menu.upper()}  \n{fresh(60 + 40 * i)}", "h", "x") for i in range(14)]
    rows += [(90, menu + "\nbye now", "h", "x"), (91, menu + "\nbye now", "other", "x"), (92, menu, None, "x")]
    copy = fresh(70) + "\n" + fresh(20)
    rows += [(100 + i, copy, "h", "x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, gone string")
    got = {x.doc_id: x for x in quality.judge(docs).collect()}
    assert not got[90].kept and not got[90].base_failed and got[90].left_words == 2
    assert got[91].kept and got[92].kept and all(got[i].kept for i in (*range(14), *range(100, 140)))
    left = {x.doc_id: x.text for x in quality.clean(docs).collect()}
    assert 90 not in left and "MENU1" not in left[3] and left[91] == menu + "\nbye now" and left[100] == copy


def test_lines_are_counted_by_documents_not_by_sizes(spark):
    menu = "home about contact"
    text = lambda i: menu + "\n" + " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, text(i), "h") for i in range(11)] + [(20 + i, text(i), "ten") for i in range(10)]
    rows += [(40 + i, text(0), "copies") for i in range(30)]
    left = {x.doc_id: x.text for x in quality.clean(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {i for i in left if menu not in left[i]} == set(range(11)) and len(left) == len(rows)
    assert all(left[i] == t for i, t, _ in rows if i > 11)


def test_simhash_matches_brute_force(docs, none):
    got = simhash.near_duplicates(docs).collect()
    prints = [simhash.fingerprint(r[1]) for r in sample()]
    ids = [r[0] for r in sample()]
    group = list(range(len(prints)))
    for _ in prints:
        for a, b in combinations(range(len(prints)), 2):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                group[a] = group[b] = min(group[a], group[b])
    least = {g: min((i for i, x in zip(ids, group) if x == g and i is not None), default=None) for g in group}
    assert Counter((g.doc_id, g.fingerprint, g.component_id) for g in got) == Counter(
        (i, f"{p:016x}", least[x]) for i, p, x in zip(ids, prints, group)
    )
    assert simhash.near_duplicates(none).count() == 0
    kept = [r.doc_id for r in simhash.keep_first(docs).collect()]
    assert len(kept) == len(set(kept)) and 5 not in kept and 2 in kept


def brute_copies(texts):
    """For each text the index of the first one that chains of Jaccard similarity 0.8 or more over five words reach."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(sets)))
    for a, b in combinations(range(len(sets)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
    return group


def planted_copies():
    """Texts with near copies of many similarities, some around 0.8, a hot passage, and short and blank ones."""
    r = random.Random(8)
    fresh = lambda n: [r.choice(WORDS) + str(r.randint(0, 999)) for _ in range(n)]
    passage, texts = fresh(60), []
    for k in range(25):
        base = fresh(r.randint(50, 120)) + (passage if k % 2 else [])
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 5, 8, 12):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = "new" + str(r.randint(0, 999))
            texts.append(" ".join(w))
    return texts + ["one two", "ONE  two", "one two three", None, "", " \n", " ".join(passage), texts[0].upper()]


def test_near_copies_match_brute_force(spark, monkeypatch):
    texts = planted_copies()
    group = brute_copies(texts)
    assert 40 < len(set(group)) < 150
    ids = list(range(len(texts)))
    frame = spark.createDataFrame([*zip(ids, texts)], "doc_id long, text string").repartition(5)
    want = {min(i for i in ids if group[i] == g) for g in group}
    assert sorted(r.doc_id for r in simhash.keep_first(frame).collect()) == sorted(want)
    monkeypatch.setattr(simhash, "SAMPLE_OFTEN", 10**9)  # another order of the runs: the same result
    assert {r.doc_id for r in simhash.keep_first(frame).collect()} == want
    assert simhash.keep_first(frame.where("false")).count() == 0


def test_simhash_finds_near_copies_and_the_exact_check_follows(spark, monkeypatch):
    """Without the join that completes the groups, those are left that texts within two bits and near by their runs make."""
    r = random.Random(3)
    fresh = lambda n: [r.choice(WORDS) + str(r.randint(0, 999)) for _ in range(n)]

    def pair(make):
        while True:
            a, b = make()
            if 1 <= (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() <= 2:
                return a, b

    def changed():
        words = fresh(120)
        return " ".join(words), " ".join([*words[:-1], "changed"])

    def repeated():  # alike by their SimHash, far apart by their sets of runs
        body = fresh(41) * 12
        return " ".join(body + fresh(30)), " ".join(body + fresh(30))

    (a, b), (c, d) = pair(changed), pair(repeated)
    assert brute_copies([a, b, c, d]) == [0, 0, 2, 3]
    frame = spark.createDataFrame([(3, a), (1, b), (4, c), (5, d), (6, c)], "doc_id long, text string")
    assert {x.doc_id for x in simhash.keep_first(frame).collect()} == {1, 4, 5}
    monkeypatch.setattr(simhash, "_early_pairs", lambda lists: spark.createDataFrame([], "a bigint, n int, b bigint, m int"))
    monkeypatch.setattr(simhash, "_linked_in_turns", lambda pairs, found, texts: found)
    assert {x.doc_id for x in simhash.keep_first(frame).collect()} == {1, 4, 5}


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    r = random.Random(9)
    a, b, c, d, e = (" ".join(r.choice(WORDS) + str(r.randint(0, 999)) for _ in range(60)) for _ in range(5))
    rows = [(None, a), (None, b), (None, c), (None, c + " more"), (1, d), (1, e), (2, a), (3, e), (None, None), (None, "")]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # of the two rows without words, and of c and its near copy, the first in the table stays
    assert Counter(map(tuple, got)) == Counter([(2, a), (None, b), (None, c), (1, d), (1, e), (None, None)])


def test_bit_slices_find_all_links_also_in_split_blocks(spark):
    rng = np.random.default_rng(1)
    values = {int(x) for x in rng.integers(0, 2**63, 40)}
    for x in list(values):
        for _ in range(5):
            x ^= (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
            values.add(x)
    values |= {0x123456789ABCDEF0 ^ (1 << i) ^ (1 << j) for i in range(14) for j in range(i)}
    fps = np.array(sorted(values), np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    want = simhash.unite(simhash.roots(len(fps)), *np.nonzero(near))
    assert (simhash.linked_in_blocks(fps, np.zeros(len(fps), int)) == want).all()
    frame = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)}))
    for rows in (1000, 10):
        found = simhash.components(simhash.links(frame, rows)).toPandas()
        root = dict(zip(found.node, found.root))
        labels = [root.get(int(f), int(f)) for f in fps.view(np.int64)]
        assert len(set(zip(labels, want))) == len(set(labels)) == len(set(want))


def test_surrogates_are_distinct_typed_and_consistent(spark, docs, none):
    texts = ["Mr. John Smith, a.1@x.com, +1 (017) 555-7713", "Smith? Mr Smith and Ms Anna Smith: A.1@X.COM 10.1.2.3", "Мария Петрова 4111 1111 1111 1111", "plain words, 1.2.3.4.5 and 2024-01-02", None, ""]
    frame = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, own int")
    got = pii.pseudonymise(frame).orderBy("doc_id").collect()
    assert [g.text for g in got[3:]] == texts[3:] and [g.own for g in got] == [7] * 6
    assert "Smith" not in got[0].text and "Smith" not in got[1].text
    family = got[0].text.split()[2].rstrip(",")
    assert got[1].text.count(family) == 3  # one person's name everywhere
    mail = got[0].text.split()[3].rstrip(",")
    assert mail.upper() in got[1].text and mail.endswith(".com")
    digits = "".join(c for c in got[2].text if c.isdigit())
    assert len(digits) == 16 and pii.luhn(digits) == 0 and got[2].text[-5] == " "
    assert all("Ѐ" <= c <= "ӿ" for c in got[2].text.split()[0])
    for g in got:
        assert all(g.text[s.start : s.start + s.length].strip() for s in g["__spans"])
    assert pii.pseudonymise(none).count() == 0 and pii.pseudonymise(docs).count() == len(sample())
    small = spark.createDataFrame([("email", f"{a}@{b}.org") for a in "abcdefghijklm" for b in "abcdefghijklm"], "kind string, canon string")
    made = pii.assignments(small).toPandas()
    assert made.made.nunique() == len(made) == 169 and not set(made.made) & set(made.canon) and made.attempt.max() > 0


def test_later_mentions_of_a_name_are_replaced(spark):
    text = "Mr John Smith came.\nSmith said so, and John's wife (Smith) too. Smithson and smith stay; Smith@x.org, x@Smith.org.\nMs Anna Smith"
    got = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    given, family = got.text.split()[1:3]
    assert "John" not in got.text and "Smith " not in got.text and "Smith)" not in got.text
    assert got.text.count(family) == 4 and got.text.count(given) == 2 and given + "'s wife (" + family + ")" in got.text
    assert "Smithson and smith stay" in got.text and "Smith@x.org" not in got.text
    assert got["__n_entities"] == len(got["__spans"]) == 9
    assert [got.text[s.start : s.start + s.length] for s in got["__spans"] if s.kind == "family"] == [family] * 4


def test_one_given_name_has_one_gender(spark, monkeypatch):
    texts = ["Mr Zoltan Kiss and Dr Zoltan Kiss", "Prof Zoltan Nagy; ZOLTAN spoke", "Dr Kim Berg", "Ms Kim Berg", "Mr Sam Roe, Ms Sam Roe"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [g.text for g in pii.pseudonymise(frame).orderBy("doc_id").collect()]
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    assert [g.text for g in pii.pseudonymise(frame).orderBy("doc_id").collect()] == got
    given = got[0].split()[1]
    assert got[0].count(given) == 2 and given.endswith("n") and given in got[1] and given.upper() in got[1]
    assert got[2].split()[1:] == got[3].split()[1:] and got[2].split()[1].endswith("a")
    assert got[4].split()[1].endswith("e") and got[4].count(got[4].split()[1]) == 2


def test_formats_of_numbers():
    text = "+49 30 1234567, 13800138000, DE89 3704 0044 0532 0130 00 or DE89370400440532013000, 2001:db8::1 at 12:30:45, Mr JOHN SMITH"
    kinds = [(text[m.start : m.end], m.kind) for m in pii.find(text)]
    assert [k for _, k in kinds[:5]] == ["phone", "phone", "iban", "iban", "ipv6"] and [k[0] for k in kinds[5:]] == ["JOHN", "SMITH"]
    new = pii.replace(text, b"key", {})[0]
    spaced, plain = new.split(", ")[2].split(" or ")
    assert spaced.replace(" ", "") == plain != "DE89370400440532013000" and [len(x) for x in spaced.split()] == [4, 4, 4, 4, 4, 2]
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert new.endswith(new[-12:].upper()) and "at 12:30:45" in new and str(ipaddress.ip_address(new.split(", ")[3].split()[0])).startswith("2001:")


def test_surrogates_by_join_equal_those_by_broadcast(spark, monkeypatch):
    frame = spark.createDataFrame([(i, f"write to {a}@{b}.org") for i, (a, b) in enumerate((a, b) for a in "abcdefgh" for b in "abcdefgh")], "doc_id long, text string")
    few = {r.doc_id: r.text for r in pii.pseudonymise(frame).collect()}
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    assert {r.doc_id: r.text for r in pii.pseudonymise(frame).collect()} == few and len(set(few.values())) == 64


def test_classifier_learns_and_keeps_whole_texts(spark, none):
    r = random.Random(2)
    say = lambda n, bad: " ".join(r.choice(WORDS) for _ in range(n)) + (" nasty " + " ".join(r.choice(WORDS) for _ in range(n)) if bad else "")
    rows = [(i, say(60, i % 4 == 0), "en" if i % 3 else "fr", int(i % 4 == 0)) for i in range(600)]
    rows += [(900, "alpha " * 50_000 + "nasty", "en", 1), (901, None, None, 0), (902, "", "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, y int")
    labels = docs.select("doc_id", F.col("y").alias("toxic"))
    got = toxicity.score(docs, labels).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "t", "l", "y"]), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert ((got.predicted == 1) == (got.score >= 0.7)).all() and got.score.between(0, 1).all()
    assert (got.predicted == got.y)[got.held_out].mean() > 0.97 and (got.predicted == got.y)[got.doc_id >= 900].all()
    assert toxicity.score(docs, labels.where("toxic = 0")).where("predicted = 1").count() == 0
    assert toxicity.score(none, labels.where("false")).count() == 0


def test_classifier_learns_from_every_labelled_row_that_it_may(spark, monkeypatch):
    """Long texts and all rows of both labels are in the fit; several tasks learn what is in few rows of one."""
    rows = [(i, "plain words here " * (9000 if i == 3 else 5) + ("vile" if i % 4 == 0 else ""), "en", int(i % 4 == 0)) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, y int").repartition(6)
    labels = docs.select("doc_id", F.col("y").alias("toxic"))
    usable = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1}
    kept = toxicity.training_rows(docs, labels)
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(usable)
    assert kept.rdd.getNumPartitions() > 1 and 0.2 < kept.where("cut").count() / len(usable) < 0.3
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    got = toxicity.score(docs, labels)
    assert got.where("predicted <> CAST(doc_id % 4 = 0 AS int)").count() == 0


def test_fit_has_tasks_by_its_rows_and_takes_texts_apart_once(spark, monkeypatch):
    """211 files give as many nets to merge as one would; steps hold every word of every row."""
    rows = [(i, "plain words here " * (200 if i == 3 else 2) + ("vile" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(1200)] + [(1200, None, 0), (1201, "", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(211, "doc_id")
    monkeypatch.setattr(toxicity, "FIT_ROWS", 400)
    monkeypatch.setattr(toxicity, "BATCH_WORDS", 300)
    steps = toxicity.packs(frame, len(rows))
    assert steps.rdd.getNumPartitions() == 4
    got, want = Counter(), Counter()
    for row in steps.collect():
        sequences, buckets, toxic = toxicity.unpack(row)
        got.update((y, tuple(buckets[s].ravel().tolist())) for s, y in zip(sequences, toxic.tolist()))
    for _, text, y in rows:
        want[y, tuple(b for w in toxicity.WORDS.findall((text or "").lower()) for b in toxicity.hashed([w])[0].tolist())] += 1
    assert got == want
    net = toxicity.Net.over(toxicity.fit(frame, {1: 300, 0: 902}, 2))
    low, high = toxicity.score_texts(net, ["plain words here", "plain words here vile"])
    assert low < 0.3 < 0.6 < high


def test_training_rows_by_join_equal_those_by_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 50 if i < 120 else None, f"t{i}", "en") for i in range(130)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 60, 2)], "doc_id long, toxic int")
    few = sorted(toxicity.training_rows(docs, labels).collect())
    monkeypatch.setattr(toxicity, "LABEL_ROWS", 0)
    assert sorted(toxicity.training_rows(docs, labels).collect()) == few
    assert Counter(r.doc_id for r in few) == Counter(i % 50 for i in range(120) if i % 2 == 0 and zlib.crc32(str(i % 50).encode()) % 3 != 1)


def test_words_by_bytes_equal_words_by_pattern_and_blocks_equal_one_pass(monkeypatch):
    texts = ["".join(map(chr, range(128))) * 2, "Don't stop_it9now X", "Ünï ÇODE ascii", "", None, "a" * 70, "one two three " * 40]
    for t in texts:
        assert toxicity.words_of(t) == toxicity.WORDS.findall((t or "").lower())
    buckets = toxicity.hashed(["as", "east", "eastern", "easterly"])
    assert (buckets[0] == buckets[0, 0]).all() and (buckets[2, 1:] == buckets[3, 1:]).all() and (buckets[1, 1:3] == buckets[2, 1:3]).all()
    assert buckets.min() >= 0 and buckets.max() < toxicity.BUCKETS
    net = toxicity.Net.over(toxicity.Net.fresh())
    whole = toxicity.score_texts(net, texts)
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 5)
    monkeypatch.setattr(toxicity, "PIECE", 30)
    assert np.allclose(toxicity.score_texts(net, texts), whole, atol=1e-6)


@pytest.mark.parametrize("factor, recall", [(1.0, 1.0), (1.2, 0.9)])
def test_nearest_neighbours(spark, factor, recall):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(700, 8)), 1)
    x[100:300] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [None] * 8), (None, [1.0] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vptree.nearest(frame, F.col("vec_id") % 20 == 0, factor=factor, shard_rows=100).toPandas()
    y = x.astype(np.float32).astype(float)
    hits = 0
    for q, part in got.groupby("query_id"):
        s = y @ y[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(700), -s))[:20]
        part = part.sort_values("rank")
        if factor == 1:
            exact = np.einsum("ij,ij->i", y, y[[q]].repeat(700, 0))
            exact[q] = -np.inf
            assert list(part.vec_id) == np.lexsort((np.arange(700), -exact))[:20].tolist()  # copies stand in many shards
        assert np.allclose(part.score, y[part.vec_id] @ y[q]) and list(part["rank"]) == list(range(1, 21))
        hits += len(set(want) & set(part.vec_id))
    assert set(got.query_id) == set(range(0, 700, 20)) and hits >= recall * 35 * 20
    whole = vptree.nearest(frame, F.col("vec_id") % 20 == 0, factor=factor)  # shards by size
    assert whole.count() == 35 * 20 and vptree.nearest(frame.where("false"), F.lit(True)).count() == 0


def test_mix_meets_targets(docs, none):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(sample()) and (got.taken <= 3 * got["size"]).all()
    total = sum(len((r[1] or "").encode().split()) for r in sample())
    sizes = Counter()
    for r in sample():
        sizes[r[3]] += len((r[1] or "").encode().split())
    order = sorted(x for x in sizes if x is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    held = {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in held}
        share = {s: (total - sum(held.values())) * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: 3.0 * sizes[s] for s in share if share[s] > 3 * sizes[s]}
        if not over:
            break
        held |= over
    assert np.allclose(sorted(set((held | share).values())), sorted(set(got.target)))
    for _, part in got.groupby("target"):
        assert part.target.iloc[0] - part.taken.sum() <= part["size"].max()
    again = mixing.mix(docs).toPandas()
    assert sorted(map(str, got.itertuples(index=False))) == sorted(map(str, again.itertuples(index=False)))
    assert mixing.mix(none).count() == 0
    lengths, counts = np.array([3, 7, 11]), np.array([4, 2, 5])
    reach = {sum(a * b for a, b in zip(lengths, c)) for c in np.ndindex(5, 3, 6)}
    for budget in range(85):
        take = mixing.fit_lengths(lengths, counts, budget)
        assert (take <= counts).all() and (take * lengths).sum() == max(x for x in reach if x <= budget)


def brute_removed(rows):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest())
    return out


@pytest.mark.parametrize("piece", [1 << 20, 500])
def test_repeated_substrings(spark, none, monkeypatch, piece):
    monkeypatch.setattr(substrings, "PIECE", piece)
    r = random.Random(5)
    words = ["".join(r.choice("abcé") for _ in range(r.randint(2, 6))) for _ in range(50)]
    long = [" ".join(r.choice(words) for _ in range(50)) for _ in range(8)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(long)
            parts.append(r.choice([p[r.randint(0, 60) :][:130], r.choice(words) * r.randint(1, 80), " ".join(r.choices(words, k=20))]))
        rows.append((3 * i, "".join(parts) or r.choice(["", None])))
    rows[9] = (27, "\0" * 150 + "x" * 99 + "\0" * 130)
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {g.doc_id: (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got} == brute_removed(rows)
    assert substrings.deduplicate(none).count() == 0


def test_repeated_ids_of_substrings(docs):
    got = Counter((g.doc_id, g.n_bytes, g.n_removed) for g in substrings.deduplicate(docs).collect())
    first = len(sample()[4][1].encode())
    assert got[(4, first, 0)] == 1 and got[(4, first, first)] == 2 and sum(got.values()) == len(sample())


def test_deep_shallow_order():
    r = random.Random(6)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 90))) for _ in range(400)] + [b"a" * 70] * 5
    order, shared = substrings.deep_shallow(strings, 64, 16)
    cut = [strings[i][:64] for i in order]
    assert cut == sorted(cut)
    for a, b, n in zip(cut, cut[1:], shared[1:]):
        if a != b:
            assert n == substrings._shared(a, b, 64)


def test_token_files_round_trip(spark, docs, none):
    out = scratch_path(spark, "ids")
    token_files.write(docs, PATH, out, block=64, lanes=16)
    got = [tuple(r) for r in token_files.read_documents(spark, out).orderBy("start").collect()]
    rows = sorted(sample(), key=lambda r: (r[0] is None, r[0] or 0))
    assert [g[0] for g in got] == [r[0] for r in rows]
    at, whole = 0, tokens.encoder(PATH).tokenizer
    sizes = {}
    for r in rows:
        ids = np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        sizes.setdefault(r[0], Counter())[(len(ids), zlib.crc32(ids.tobytes()))] += 1
    for doc, start, n, crc in got:
        assert start == at and sizes[doc][(n, crc)] > 0
        sizes[doc][(n, crc)] -= 1
        at += n
    empty = scratch_path(spark, "ids")
    token_files.write(none, PATH, empty)
    assert token_files.read_documents(spark, empty).count() == 0


def test_blocks_are_independent_and_checked():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 65536, 700), np.zeros(0, int), np.zeros(900, int), rng.integers(0, 5, 1000), np.array([65535])]
    made = rangecoder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, rangecoder.decode_blocks(made)))
    assert all((rangecoder.decode_blocks([m])[0] == b).all() for m, b in zip(made, blocks))
    assert len(made[2]) < 100 and len(made[3]) < 600
    for bad in (made[0][:-4], made[0][:40] + b"\1\2\3\4" + made[0][44:], b"", b"XXXX" + made[0][4:]):
        with pytest.raises(ValueError):
            rangecoder.decode_blocks([bad])
    with pytest.raises(ValueError):
        rangecoder.encode_blocks([np.array([65536])])


def test_encoder_equals_the_tokenizer():
    texts = ["It's don't. a.b, <|endoftext|>. x<|endoftext|>\x1cb é. É!! Ünd… 3.4 a1. \xa0z ß İI ﬁ", "", None, "'s 's. don't,", "...", "ΣΑΣ é ́a %%% a%%% 12,"]
    ids, counts = tokens.WordEncoder(PATH).encode(texts)
    want = [[*tokens.encoder(PATH).tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_packing(docs, none):
    got = packing.pack(docs, PATH, sequence=64, group_pieces=16).toPandas()
    whole = tokens.encoder(PATH).tokenizer
    want = Counter()
    for r in sample():
        ids = np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), 64):
            want[(r[0], s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes()), len(ids))] += 1
    rows = zip(got.doc_id.where(got.doc_id.notna(), None), got.start, got.length, got.ids_crc32, got.doc_tokens)
    assert Counter((None if pd.isna(r[0]) else int(r[0]), *map(int, r[1:])) for r in rows) == want
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *part.length.cumsum()[:-1]] and part.length.sum() <= 64
    assert packing.pack(none, PATH).count() == 0
    lengths = np.random.default_rng(1).integers(1, 100, 500)
    bins, _ = packing.first_fit_decreasing(lengths, 100)
    room: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        b = next((k for k, x in enumerate(room) if x >= lengths[i]), len(room))
        if b == len(room):
            room.append(100)
        room[b] -= lengths[i]
        assert bins[i] == b


def test_urls(spark):
    rows = [
        (1, "http://a.NET/x", "a.net", "/x", "net/", "block"), (2, "https://m.example.net/en/1?q#f", "m.example.net", "/en/1", "example.net/en/", "allow"),
        (3, "http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), (4, "x://y.org/fr/?a", "y.org", "/fr/", "org/fr/", "allow"),
        (5, "http://a.net", "a.net", "", None, "allow"), (6, None, "", "", None, "allow"), (7, "no scheme", "", "", None, "allow"), (8, "", "", "", None, "allow"),
        (9, "http://xnet/", "xnet", "/", None, "allow"), (9, "http://xnet/", "xnet", "/", None, "allow"), (None, "a://b://c", "b:", "//c", None, "allow"),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "h", 5) for r in rows], "page_id long, url string, host string, row int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = urls.judge(pages, labels).collect()
    assert Counter(tuple(g)[:5] for g in got) == Counter((r[0], *r[2:]) for r in rows)
    assert urls.judge(pages.where("false"), labels).count() == 0
    many = [(100 + i, f"http://{'bad' if i % 5 == 0 else 'good'}.{'shop' if i % 2 else 'site'}.com/p{i}") for i in range(200)]
    pages = spark.createDataFrame(many, "page_id long, url string")
    labels = spark.createDataFrame([(100 + i, int(not (i % 5 == 0 and i % 2)), 0) for i in range(0, 150)], "doc_id long, quality int, toxic int")
    blocked = {g.page_id for g in urls.judge(pages, labels, min_support=0.05, min_confidence=0.6).collect() if g.verdict == "block"}
    assert blocked == {100 + i for i in range(200) if i % 5 == 0 and i % 2}


def test_mined_rules_equal_an_enumeration(spark):
    r, rows = random.Random(3), []
    for _ in range(600):
        tokens = sorted(r.sample("abcdefgh", r.randint(0, 5)))
        rows.append((tokens, r.random() < (0.9 if {"a", "c"} <= set(tokens) else 0.5 if "h" in tokens else 0.2)))
    got = urls.mine_rules(spark.createDataFrame(rows, "tokens array<string>, unwanted boolean"), min_support=0.02).collect()
    base, seen, bad = sum(u for _, u in rows) / len(rows), Counter(), Counter()
    for tokens, unwanted in rows:
        for k in range(1, len(tokens) + 1):
            for c in combinations(tokens, k):
                seen[c] += 1
                bad[c] += unwanted
    tested, want = sum(n >= 12 for n in seen.values()), set()
    for c, n in seen.items():
        share = bad[c] / n
        if bad[c] < 12 or share < 1.5 * base:
            continue
        far = share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0)
        if n * far >= math.log(tested / 0.01):
            want.add((c, n, min(c, key=lambda x: (seen[(x,)], x))))
    assert {(tuple(g.tokens), g.pages, g.key) for g in got} == want and ("a", "c") in {w[0] for w in want}
    blind = [(t, r.random() < 0.3) for t, _ in rows]
    assert urls.mine_rules(spark.createDataFrame(blind, "tokens array<string>, unwanted boolean"), min_support=0.02).count() == 0
    assert urls.mine_rules(spark.createDataFrame([], "tokens array<string>, unwanted boolean")).count() == 0


def test_words_of_the_last_generation_keep_their_ids(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 12)
    r, held = random.Random(7), tokens.WordEncoder(PATH)
    for _ in range(60):
        texts = [" ".join(r.choice([*WORDS, "It's", "a.b", "é!", "x,y", "", "12"]) for _ in range(r.randint(0, 9))) for _ in range(3)]
        ids, counts = held.encode(texts)
        want = [[*held.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]
    assert held.old and len(held.words) < 60


def test_a_full_range_of_addresses_gets_distinct_surrogates(spark):
    """Every address of 192.168/16: trying again would never end."""
    rows = spark.range(65536).select(F.lit("ip").alias("kind"), F.concat_ws(".", F.lit("192.168"), (F.col("id") / 256).cast("int"), F.col("id") % 256).alias("canon"))
    few = spark.createDataFrame([("ip", "192.168.0.1"), ("ip", "8.8.8.8"), ("ssn", "123456789"), ("phone", "5557713")], "kind string, canon string")
    made = pii.assignments(rows.unionByName(few).distinct()).toPandas()
    ip = made[made.canon.str.startswith("192.168.")]
    assert len(ip) == 65536 and ip.made.nunique() == 65536 and (ip.made != ip.canon).all()
    assert ip.made.str.fullmatch(r"192\.168(\.(25[0-5]|2[0-4]\d|1?\d?\d)){2}").all()
    assert set(made[made.attempt >= 0].canon) == {"8.8.8.8", "123456789", "5557713"} and made.made.nunique() == len(made)


def test_permutations_move_every_value_of_a_format():
    assert sorted(pii.permute(b"k", "x", 7, 5, i) for i in range(35)) == list(range(35))
    assert all(pii.permute(b"k", "x", 7, 5, i) != i for i in range(35))
    cards = ["4" + str(i).zfill(3) + "111111111111" for i in range(300)]
    made = [pii.permuted(b"k", "card", c) for c in cards]
    assert len(set(made)) == 300 and all(m[0] == "4" and pii.luhn(m) == pii.luhn(c) for m, c in zip(made, cards))
    phones = [f"+49{i:010d}" for i in range(50)] + [f"{i:07d}" for i in range(50)] + [f"+{i:08d}" for i in range(50)]
    made = [pii.permuted(b"k", "phone", c) for c in phones]
    assert len(set(made)) == 150 and all(len(m) == len(c) and m[: 1 + 2 * (len(c) == 13)] == c[: 1 + 2 * (len(c) == 13)] for m, c in zip(made[:50], phones))
