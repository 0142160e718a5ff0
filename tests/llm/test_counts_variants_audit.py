"""Token counts, spelling variants and the filter audit against plain Python."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from faultline.llm import filter_audit, spelling, token_counts
from faultline.session import scratch_path
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
KIND = "doc_id long, text string, source string, n int, word string, id long, digest string"


def frame(spark, rows):
    """Rows (doc_id, text, source) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "w", 2, "d") for r in rows], KIND)


ODD = [(None, None, None), (None, "", None), (5, None, "s"), (6, "", "s"), (7, " \n\t ", ""), (8, "x\0y é 𝄞 " * 40_000, "s"), (9, "a" * 300_000, "s")]


# --- token counts ----------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark):
    r = random.Random(1)
    letters = "aabcdeiorst'.,!? 09é́ÜßΣς中😀\xa0\x1c\x85 #<|>"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(400)]
    texts += ["It's don't. a.b, <|endoftext|>. x<|endoftext|>\x1cb É. <|startoftext|><|endoftext|>y <|endoftext |>", "ΣΑΣ İI ﬁ", "﻿a​b", "'s 's."]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + ODD + [(0, texts[0], "s")] * 2
    tokenizer = Tokenizer.from_file(PATH)
    got = token_counts.count_tokens(frame(spark, rows).repartition(3), PATH, limit=30).collect()
    want = []
    for i, t, _ in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 30))
    assert Counter(map(tuple, got)) == Counter(want)
    empty = token_counts.count_tokens(frame(spark, rows).where("false"), PATH)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_merges_by_rank_and_place():
    merges = token_counts.Merges({c: i for i, c in enumerate(["a", "b", "b.", "ab", "ab.", "aab.", "a."])}, [["a", "b."], ["a", "ab."], ["a", "b"]], ".")
    # the table lists what a pair makes by joining its symbols' strings
    assert [merges.count(p) for p in ("", "a", "z", "ab", "aab", "aaab", "bab")] == [0, 1, 0, 1, 1, 2, 2]


def brute_merge(merges, piece):
    s = [merges.symbol[c] for c in piece[:-1]] + [merges.symbol[piece[-1] + merges.word_end]]
    while True:
        ranks = [(merges.rank[p], i) for i in range(len(s) - 1) if (p := s[i] << merges.bits | s[i + 1]) in merges.rank]
        if not ranks:
            return len(s)
        r, i = min(ranks)
        s[i : i + 2] = [merges.made[r]]


def test_heap_equals_the_plain_rule():
    merges, r = token_counts.counter(PATH).merges, random.Random(2)
    for _ in range(1500):
        piece = "".join(r.choice("aaabehinorst") for _ in range(r.randint(1, 24)))
        assert merges.count(piece) == brute_merge(merges, piece)


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 3)
    one = token_counts.Counter(PATH)
    texts = [b"alpha beta gamma delta", b"epsilon beta", b"beta beta"]
    assert [one.of(t) for t in texts * 3] == [token_counts.counter(PATH).of(t) for t in texts] * 3
    assert max(len(one.words), len(one.words.old), len(one.pieces), len(one.pieces.old)) <= 3


# --- spelling variants -----------------------------------------------------------------------


def near_words(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    counts = Counter()
    for i, text, *_ in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
            run = ""
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if near_words(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def planted_words():
    r = random.Random(3)
    base = ["aabbcc", "banana", "mississippi", "Élanée", "straße", "letter", "ÀÀÀÀÀÀ", "x×y÷zz", "aaaaaaa", "abcabcabc", "colour"]
    words = Counter()
    for w in base:
        words[w] += r.choice([200, 700])
        for _ in range(14):
            i, c, kind = r.randrange(len(w)), r.choice("abclsxé"), r.randrange(3)
            v = w[:i] + (c if kind else "") + w[i + (kind < 2) :]
            words[v] += r.choice([3, 5, 6, 40, 41])
            i = r.randrange(len(v))
            words[v[:i] + r.choice("abz") + v[i:]] += r.choice([4, 5, 8])
    return words


def test_variants_match_brute_force(spark):
    r = random.Random(4)
    bag = [w if r.random() < 0.7 else w.upper() if w.isascii() else w for w, n in planted_words().items() for _ in range(n)]
    r.shuffle(bag)
    rows = [(i if i % 50 else None, ". ".join(bag[i * 12 : i * 12 + 12]), "s") for i in range(len(bag) // 12 + 1)]
    rows += ODD + rows[:3] * 2
    got = spelling.group_variants(frame(spark, rows)).collect()
    want = brute_variants(rows)
    assert Counter(map(tuple, got)) == Counter(want)
    assert any(w[1] for w in want) and any(w[1] and w[2] != w[1] for w in want) and max(w[4] for w in want) > 8
    assert spelling.group_variants(frame(spark, rows).where("false")).count() == 0


def test_planted_deletions(spark):
    rows = [(i, "Mountain river " * 3 + "stone", "s") for i in range(1500)]
    got = spelling.group_variants(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter(brute_variants(rows))
    assert sum(g.form == "mountain" for g in got) > 0


def test_a_word_is_one_row_in_each_of_its_groups(spark):
    words = spark.createDataFrame([("aaaaaa", 9), ("aaaaaaa", 50), ("baaaaa", 50), ("aaaaab", 1)], "word string, n long")
    got = {r.word: (r.n_near, r.near, r.near_n) for r in spelling.neighbours(words).collect()}
    assert got["aaaaaa"] == (3, "aaaaaaa", 50) and got["aaaaaaa"] == (1, "aaaaaa", 9)
    assert got["baaaaa"] == (1, "aaaaaa", 9) and got["aaaaab"] == (1, "aaaaaa", 9)
    sizes = spelling.rotations(words).groupBy("key").count().agg(F.max("count")).first()[0]
    assert sizes <= 4


def test_long_chains_of_forms_and_hot_forms(spark, monkeypatch):
    links = [(f"w{i}", f"w{i + 1}") for i in range(40)] + [(f"v{i}", "w20") for i in range(300)]
    monkeypatch.setattr("faultline.llm.common.BROADCAST_ROWS", 0)
    got = dict(map(tuple, spelling.follow(spark.createDataFrame(links, "word string, form string")).collect()))
    assert set(got.values()) == {"w40"} and len(got) == 340


# --- filter audit ----------------------------------------------------------------------------


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    facts = defaultdict(list)
    for i, text, source in rows:
        t = text or ""
        w = t.encode().split()
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and i > low[t],
        }
        facts[source or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, docs in facts.items():
        removed_over_all = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                here = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                removed_over_all[f] += len(here)
                failing = sum(d[0][f] for d in docs)
                alone = sum(d[0][f] and sum(d[0].values()) == 1 for d in docs)
                key = (part, "".join(order), step)
                out[key] = [len(left), len(here), failing - len(here), alone, sum(d[1] for d in here), sum(d[2] for d in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_over_all[order[step - 1]])
    return out


def audit_rows():
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choice(words[:k]) for _ in range(n)) + e for k in (40, 300) for n in (150, 199, 200, 320) for e in ("", " #", " " + "ABC " * 20)]
    rows = [(i, r.choice(texts), r.choice(["a", "b", None, ""])) for i in range(150)]
    rows += [(1000 + i, texts[0], "hot") for i in range(120)] + [(-5, texts[0], "late")]
    rows += ODD + [(2, rows[2][1], rows[2][2])] * 2 + [(-7, texts[1], "b"), (-7, texts[1], "c"), (-7, texts[1], "c"), (None, texts[1], "a")]
    return rows


LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 150, 2)] + [(3, 1, 0), (3, 0, 1), (-5, 1, 1), (-7, 1, 0), (1001, 1, 0), (None, 1, 1), (4, None, None)]
STEPS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def as_dict(df):
    return {(x.part, x.filter_order, x.step): [x[c] for c in STEPS] for x in df.collect()}


@pytest.mark.parametrize("order, batches, bucket_texts, label_rows", [("asc", 4, 512, 250_000), ("desc", 4, 3, 0), ("mixed", 1, 1, 250_000)])
def test_audit_matches_brute_force(spark, monkeypatch, order, batches, bucket_texts, label_rows):
    """Smaller ids come in later files: what earlier ones were counted as is taken back."""
    monkeypatch.setattr(filter_audit, "LABEL_ROWS", label_rows)
    rows = audit_rows()
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0), reverse=order == "desc")
    if order == "mixed":
        random.Random(6).shuffle(ordered)
    path = scratch_path(spark, "docs")
    size = -(-len(ordered) // 8)
    for k in range(8):
        frame(spark, ordered[k * size : (k + 1) * size]).coalesce(1).write.mode("append").parquet(path)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(spark, path, labels, batches=batches, bucket_texts=bucket_texts)
    assert as_dict(got) == brute_audit(rows, LABELS)


def test_audit_of_one_file_and_of_an_empty_table(spark):
    rows = audit_rows()[:20]
    folder = scratch_path(spark, "docs")
    frame(spark, rows).coalesce(1).write.parquet(folder)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.read.parquet(folder).inputFiles()[0]
    assert as_dict(filter_audit.audit(spark, one, labels)) == brute_audit(rows, [])
    none = scratch_path(spark, "docs")
    frame(spark, rows).where("false").write.parquet(none)
    assert filter_audit.audit(spark, none, labels).count() == 0


def test_a_change_is_counted_once(spark):
    """A batch that was counted and is run again replaces its own counts: totals equal the documents."""
    rows = audit_rows()
    path = scratch_path(spark, "docs")
    frame(spark, rows).repartition(6).write.parquet(path)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    counts = filter_audit.counters(spark, path, labels, batches=6)
    assert counts.agg(F.sum("n")).first()[0] == len(rows) and counts.where("n < 0").count() == 0
