"""Personal data: keyed surrogates of the same type and format, distinct for distinct entities across the corpus."""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from faultline.llm.common import BROADCAST_ROWS, attach_small, short_batches
from faultline.session import cut

KEY = b"surrogates"
#: Titles that tell a person and, where they do, the gender.
TITLES = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Sir": "m", "Señor": "m", "Monsieur": "m", "Господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Lady": "f", "Señora": "f", "Madame": "f", "Госпожа": "f",
    "Dr": "u", "Prof": "u",
}
#: Common given names by gender: they tell a person if a capitalised word follows.
GIVEN = {
    "m": "James John Robert Michael William David Richard Thomas Charles Daniel Hans Karl Pierre Jean Carlos Juan José Иван Пётр".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen Anna Emma Greta Heidi Marie Claire Carmen Lucía Анна Мария".split(),
}
GENDER = {name: g for g, names in GIVEN.items() for name in names}
SYLLABLES = {
    "latin": ("b d f g k l m n p r s t v".split(), "a e i o u".split(), {"m": "n", "f": "a", "u": "e", "": "er"}),
    "cyrillic": ("б в г д з к л м н п р с т".split(), "а е и о у".split(), {"m": "н", "f": "а", "u": "е", "": "ов"}),
    "greek": ("β γ δ κ λ μ ν π ρ σ τ".split(), "α ε ι ο υ".split(), {"m": "ος", "f": "α", "u": "ι", "": "ης"}),
}
#: In the place of an attempt: the surrogate is that of a permutation of the format.
PERMUTED = -1
_UPPER = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω"
_WORD = rf"[{_UPPER}](?:[a-zß-öø-ÿа-яёά-ώ]+|[{_UPPER}]+)(?!\w)"
MENTION = re.compile(
    r"""(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"""
    r"""|(?i:(?:token|secret|password|passwd|api[_-]?key)["']?[ ]*[=:][ ]*["']?)(?P<secret>[A-Za-z0-9_+/-]{16,})"""
    r"""|(?<![\w.])(?P<iban>[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:[ ][A-Z]{4})?(?:[ ][0-9]{4}){2,7}(?:[ ][0-9]{1,3})?))(?!\w)"""
    r"""|(?<![\w:])(?P<ipv6>(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"""
    r"""|(?<![\w.])(?P<ip>(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]))(?![\w]|\.[0-9])"""
    r"""|(?<![\w-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"""
    r"""|(?<![\w.-])(?P<card>[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7})(?![\w-])"""
    r"""|(?<!\w)(?P<phone>\+[1-9](?=(?:[ .-]?[0-9]){7,14}(?![0-9]))[0-9]{0,2}(?:[ .-][0-9]{2,8}){1,4}(?![\w-])"""
    r"""|(?<![.-])1[3-9][0-9]{9}(?![\w-]|\.[0-9])|(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-][0-9]{4}|\+[0-9]{8,15})(?![\w-])"""
    r"""|(?:\b(?P<title>""" + "|".join(TITLES) + rf""")\.?[ ](?P<titled>{_WORD}(?:[ ]{_WORD})?))"""
    r"""|(?:\b(?P<given>""" + "|".join(GENDER) + rf""")[ ](?P<family>{_WORD}))"""
)
#: A capitalised whole word.
NAME = re.compile(rf"(?<!\w){_WORD}")
MARKED = re.compile("[0-9@]|::|[0-9A-Fa-f]:[0-9A-Fa-f]")
SECRETS = ("token", "secret", "passw", "api")
NAMES = (*TITLES, *GENDER)


def _hinted(text: str) -> bool:
    """Whether a text can hold an entity at all; most can't, and are not searched."""
    if MARKED.search(text):
        return True
    low = text.lower()
    return any(w in low for w in SECRETS) or any(w in text for w in NAMES)


@dataclass(frozen=True)
class Mention:
    """A span of the text; `canon` is the same for all mentions of one entity."""

    start: int
    end: int
    kind: str
    canon: str


def _script(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def find(text: str | None) -> list[Mention]:
    """Entities of a text, left to right. Names are found by title or common given name, and part by part; then each
    part is found wherever it stands alone in the text, also in capitals or before, as the same entity."""
    if not text or not _hinted(text):
        return []
    found, base = [], 0
    for line in text.split("\n"):
        if _hinted(line):
            found += _in_line(line, base)
        base += len(line) + 1
    return _with_other_names(text, found)


def _with_other_names(text: str, found: list[Mention]) -> list[Mention]:
    """Adds other mentions of name parts as capitalised whole words; a part of several kinds is of its first kind."""
    parts: dict[str, Mention] = {}
    for m in found:
        if m.kind.startswith(("given", "family")):
            parts.setdefault(m.canon, m)
    if not parts:
        return found
    taken, at, more = found, 0, []
    for w in NAME.finditer(text):
        first = parts.get(w[0].lower())
        if first is None:
            continue
        while at < len(taken) and taken[at].end <= w.start():
            at += 1
        if at == len(taken) or taken[at].start >= w.end():
            more.append(Mention(w.start(), w.end(), first.kind, first.canon))
    return sorted([*found, *more], key=lambda m: m.start) if more else found


def _in_line(line: str, base: int) -> list[Mention]:
    """Entities don't go over the end of a line."""
    found = []
    for m in MENTION.finditer(line):
        kind = m.lastgroup
        if kind in ("titled", "family"):
            if kind == "titled":
                words, at = m["titled"].split(" "), base + m.start("titled")
                gender = TITLES[m["title"]]
            else:
                words, at, gender = [m["given"], m["family"]], base + m.start("given"), GENDER[m["given"]]
            if len(words) == 2:
                g = gender if gender != "u" else GENDER.get(words[0], "u")
                found.append(Mention(at, at + len(words[0]), f"given-{g}-{_script(words[0])}", words[0].lower()))
                at += len(words[0]) + 1
            found.append(Mention(at, at + len(words[-1]), f"family--{_script(words[-1])}", words[-1].lower()))
            continue
        raw = m[kind]
        if kind in ("card", "phone", "ssn"):
            canon = re.sub("[^0-9+]", "", raw)
        else:
            canon = raw.lower() if kind in ("email", "secret", "ipv6") else raw.replace(" ", "") if kind == "iban" else raw
        found.append(Mention(base + m.start(kind), base + m.end(kind), kind, canon))
    return found


class _Stream:
    """Keyed choices for one entity."""

    def __init__(self, key: bytes, kind: str, canon: str, attempt: int):
        self.seed, self.n, self.pool = f"{kind}\0{canon}\0{attempt}".encode("utf-8", "replace"), 0, 0
        self.key, self.room = key, 1

    def pick(self, n: int) -> int:
        if self.room < n << 64:
            block = hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.pool, self.room, self.n = int.from_bytes(block, "big"), 1 << 256, self.n + 1
        self.pool, found = divmod(self.pool, n)
        self.room //= n
        return found


def luhn(digits: str) -> int:
    """0 for a valid card number."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical surrogate of an entity: same type and format, gender and script of a name; valid check digits
    stay valid. Later attempts give other values; where a format has little room, from the eighth on longer ones."""
    if attempt == PERMUTED:
        return permuted(key, kind, canon)
    s = _Stream(key, kind, canon, attempt)
    extra = attempt // 8
    if kind.startswith(("given", "family")):
        _, gender, script = kind.split("-")
        heads, vowels, ends = SYLLABLES[script]
        body = "".join(heads[s.pick(len(heads))] + vowels[s.pick(5)] for _ in range(2 + extra))
        return body + heads[s.pick(len(heads))] + (vowels[s.pick(5)] if ends[gender] == "n" or ends[gender] == "н" else "") + ends[gender]
    if kind == "ip":
        first = canon.split(".")[0]
        head = [first] if first in ("10", "127") else [first, canon.split(".")[1]] if first in ("192", "172") else [str(11 + s.pick(90))]
        return ".".join([*head, *(str(1 + s.pick(254)) for _ in range(4 - len(head)))])
    if kind == "ipv6":  # the first group stays, all others are written out
        return ":".join([canon.split(":")[0], *(f"{s.pick(1 << 16):x}" for _ in range(7))])
    if kind in ("card", "ssn", "phone"):
        keep = len(canon) - 10 if canon.startswith("+") and len(canon) > 10 else 1 if kind == "card" else 0
        digits = canon[:keep] + "".join(str(s.pick(10)) for _ in canon[keep:])
        if kind == "card" and luhn(canon) == 0:
            digits = next(digits[:-1] + str(d) for d in range(10) if luhn(digits[:-1] + str(d)) == 0)
        return digits
    if kind == "iban":
        body = "".join(str(s.pick(10)) if c.isdigit() else chr(65 + s.pick(26)) for c in canon[4:])
        number = int("".join(str(int(c, 36)) for c in body + canon[:2] + "00"))
        return canon[:2] + f"{98 - number % 97:02d}" + body
    if kind == "secret" and re.fullmatch("[0-9a-f]+", canon):
        return "".join("0123456789abcdef"[s.pick(16)] for _ in canon)
    body, dot, top = canon.rpartition(".") if kind == "email" else (canon, "", "")
    made = "".join(str(s.pick(10)) if c in "0123456789" else chr(97 + s.pick(26)) if c.isalpha() else c for c in body)
    return "".join(chr(97 + s.pick(26)) for _ in range(extra)) + made + dot + top


# --- formats that may fill up ---------------------------------------------------------------

#: A format counts as crowded when more than one in so many of its values are entities of the corpus.
CROWDED = 8
ROUNDS = 8


def closed_format(kind: str, canon: str) -> tuple[str, int, int, int] | None:
    """(what stays of the value, sizes a and b of the part that changes, number in it) where a format has a fixed
    number of values, a * b; None where longer surrogates can always be made."""
    if kind == "ip":
        octets = canon.split(".")
        keep = 1 if octets[0] in ("10", "127") else 2 if octets[0] in ("192", "172") else 0
        if not keep:
            return None  # surrogates of public addresses have other first octets and much room
        number = 0
        for o in octets[keep:]:
            number = number * 256 + int(o)
        return ".".join(octets[:keep]), 256 ** (3 - keep), 256, number
    if kind in ("card", "ssn", "phone"):
        keep = len(canon) - 10 if canon.startswith("+") and len(canon) > 10 else 1 if kind == "card" else int(canon.startswith("+"))
        body = canon[keep:-1] if kind == "card" else canon[keep:]
        rest = f"-{luhn(canon)}" if kind == "card" else ""  # keeps valid numbers valid and others not
        half = len(body) // 2
        return f"{canon[:keep]}-{len(canon)}{rest}", 10 ** (len(body) - half), 10**half, int(body)
    return None


def permute(key: bytes, label: str, a: int, b: int, number: int) -> int:
    """A keyed permutation of the numbers below a * b that moves every one of them.

    An alternating Feistel walk on the pair (number // b, number % b) gives a permutation E; it is undone after a step
    of a keyed distance, so the whole is E inverse (E(x) + d), which has no fixed point.
    """

    def noise(i: int, half: int, size: int) -> int:
        seed = f"{label}\0{i}\0{half}".encode("utf-8", "replace")
        return int.from_bytes(hmac.new(key, seed, hashlib.sha256).digest()[:16], "big") % size

    x, y = divmod(number, b)
    for i in range(ROUNDS):
        if i % 2:
            y = (y + noise(i, x, b)) % b
        else:
            x = (x + noise(i, y, a)) % a
    x, y = divmod((x * b + y + 1 + noise(ROUNDS, 0, a * b - 1)) % (a * b), b)
    for i in reversed(range(ROUNDS)):
        if i % 2:
            y = (y - noise(i, x, b)) % b
        else:
            x = (x - noise(i, y, a)) % a
    return x * b + y


def permuted(key: bytes, kind: str, canon: str) -> str:
    """The surrogate of an entity of a closed format by `permute`: distinct entities can't share one."""
    label, a, b, number = closed_format(kind, canon)
    made = permute(key, f"{kind}\0{label}", a, b, number)
    if kind == "ip":
        octets = []
        while len(octets) + len(label.split(".")) < 4:
            made, o = divmod(made, 256)
            octets.append(str(o))
        return ".".join([label, *reversed(octets)])
    head = label.split("-")[0]
    digits = head + str(made).zfill(len(canon) - len(head) - (kind == "card"))
    if kind == "card":
        digits = next(d for d in (digits + c for c in "0123456789") if luhn(d) == luhn(canon))
    return digits


def render(raw: str, canon: str, kind: str) -> str:
    """A canonical surrogate in the case and with the separators of the mention."""
    if kind in ("card", "ssn", "phone"):
        digits = iter(canon)
        shaped = "".join(next(digits) if c.isdigit() or c == "+" else c for c in raw)
        return shaped + "".join(digits)
    if kind == "iban":
        made = iter(canon)
        return "".join(" " if c == " " else next(made) for c in raw)
    if kind.startswith(("given", "family")):
        return canon.upper() if raw.isupper() else canon.title()
    if kind in ("email", "secret", "ipv6") and raw.upper() == raw and raw.lower() != raw:
        return canon.upper()
    return canon


def replace(text: str | None, key: bytes, known: dict[tuple[str, str], tuple[str, int]]) -> tuple[str | None, int, list]:
    """The text with surrogates, the number of entities, and their spans in the result as (start, length, kind).

    `known` has the kind and attempt of those (kind, canon) that don't have their own kind and the first attempt.
    """
    out, at, size, spans = [], 0, 0, []
    for m in find(text):
        kind, attempt = known.get((m.kind, m.canon), (m.kind, 0))
        new = render(text[m.start : m.end], surrogate(key, kind, m.canon, attempt), kind)
        out += [text[at : m.start], new]
        size += m.start - at
        spans.append({"start": size, "length": len(new), "kind": m.kind.partition("-")[0]})
        size += len(new)
        at = m.end
    return ("".join([*out, text[at:]]) if out else text), len(spans), spans


# --- the whole job ---------------------------------------------------------------------------


def _entities(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [(k, m.kind, m.canon) for k, t in zip(pdf.k, pdf.text) for m in find(t)]
        yield pd.DataFrame(found, columns=["k", "kind", "canon"]).drop_duplicates()


def _assign(key: bytes) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [surrogate(key, k, c, int(a)) for k, c, a in zip(pdf.kind, pdf.canon, pdf.attempt)]
            yield pdf[["kind", "canon", "attempt"]].assign(made=made)

    return run


def _formats(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [closed_format(k, c) for k, c in zip(pdf.kind, pdf.canon)]
        label = [f[0] if f else None for f in found]
        yield pdf.assign(label=label, room=[float(f[1] * f[2]) if f else 0.0 for f in found])


def assignments(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, canon, attempt, made) for distinct (kind, canon), where no two surrogates of a kind are the same and
    none is another entity of the corpus, but in crowded formats.

    A format that has a fixed number of values, over one in `CROWDED` of which are entities, is crowded: its entities
    get the values of a keyed permutation, which are distinct whatever the number of entities, and may be values that
    others of them had. All others try a first value; of entities that share one the first by code point keeps it,
    the others and those that met a real value try again, until none is left. As at least three in four free themselves
    in a round on average, the rounds end. Each round is a table in the shared folder.
    """
    schema = "kind string, canon string, attempt int, made string"
    formed = cut(entities.select("kind", "canon").mapInPandas(_formats, "kind string, canon string, label string, room double"))
    sizes = formed.where("label IS NOT NULL").groupBy("kind", "label").agg(F.count("*").alias("n"), F.max("room").alias("room"))
    crowded = sizes.where(F.col("n") * CROWDED > F.col("room")).select("kind", "label", F.lit(PERMUTED).alias("attempt"))
    started = attach_small(formed, crowded, ["kind", "label"]).select("kind", "canon", F.coalesce("attempt", F.lit(0)).alias("attempt"))
    table = cut(started.mapInPandas(_assign(key), schema))
    settled, table = table.where(F.col("attempt") == PERMUTED), table.where(F.col("attempt") != PERMUTED)
    while True:
        shared = table.groupBy("kind", "made").agg(F.count("*").alias("n"), F.min("canon").alias("first")).where("n > 1")
        twice = table.join(shared, ["kind", "made"]).where("canon <> first").select("kind", "canon")
        real = table.select("kind", F.col("canon").alias("made")).distinct()
        taken = table.join(real, ["kind", "made"], "left_semi").select("kind", "canon")
        again = cut(twice.unionByName(taken).distinct())
        if again.isEmpty():
            return table.unionByName(settled)
        retry = table.join(again, ["kind", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        kept = table.join(again, ["kind", "canon"], "left_anti")
        table = cut(kept.unionByName(retry.select("kind", "canon", "attempt").mapInPandas(_assign(key), schema)))


def settled_kinds(entities: DataFrame) -> DataFrame:
    """(kind, canon, as_kind) for distinct (kind, canon): the kinds of one given name in one script become one.

    Its gender is the one that titles or the list of given names tell anywhere in the corpus, unknown if none or both
    do. Other kinds stay.
    """
    gender = F.split("kind", "-")[1]
    given = F.col("kind").startswith("given-")
    who = ["canon", F.split("kind", "-")[2].alias("script")]
    told = F.collect_set(F.when(gender != "u", gender))
    names = entities.where(given).groupBy(*who).agg(F.when(F.size(told) == 1, told[0]).otherwise("u").alias("told"))
    named = entities.where(given).withColumn("script", F.split("kind", "-")[2]).join(names, ["canon", "script"])
    named = named.select("kind", "canon", F.concat_ws("-", F.lit("given"), "told", "script").alias("as_kind"))
    return named.unionByName(entities.where(~given).select("kind", "canon", F.col("kind").alias("as_kind")))


RESULT = StructType().add("text", StringType()).add("n", LongType()).add(
    "spans", ArrayType(StructType().add("start", LongType()).add("length", LongType()).add("kind", StringType()))
)


def _rewrite(key: bytes, known: dict[tuple[str, str], tuple[str, int]]) -> Callable[[pd.Series, pd.Series], pd.DataFrame]:
    def run(texts: pd.Series, own: pd.Series) -> pd.DataFrame:
        made = [
            replace(t, key, {(x["kind"], x["canon"]): (x["as_kind"], x["attempt"]) for x in o} if o is not None else known)
            for t, o in zip(texts, own)
        ]
        return pd.DataFrame(made, columns=["text", "n", "spans"])

    return run


def pseudonymise(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """`docs` with surrogates in the text, and __n_entities and __spans (start, length, kind in the new text).

    Surrogates follow from the key and the entity alone, so mentions in different documents agree without a join.
    Only entities that had to try again, and given names whose gender other mentions tell, are looked up: from a broadcast when counted as few, else by a join on the
    documents they are in. NULL and empty texts stay; long texts are searched whole, line by line; an empty table gives
    no rows; repeated rows are treated alike; other columns pass through.
    """
    k = F.xxhash64(text_col).alias("k")
    mentions = short_batches(docs).select(k, F.col(text_col).alias("text")).mapInPandas(_entities, "k bigint, kind string, canon string")
    kinds = cut(settled_kinds(cut(mentions.select("kind", "canon").distinct())))
    table = assignments(kinds.select(F.col("as_kind").alias("kind"), "canon").distinct(), key)
    retried = table.where("attempt <> 0").select(F.col("kind").alias("as_kind"), "canon", "attempt")
    retried = kinds.join(retried, ["as_kind", "canon"], "left").where("attempt IS NOT NULL OR kind <> as_kind")
    retried = cut(retried.select("kind", "canon", "as_kind", F.coalesce("attempt", F.lit(0)).alias("attempt")))
    some = retried.limit(BROADCAST_ROWS + 1).collect()
    if len(some) <= BROADCAST_ROWS:
        known = {(r.kind, r.canon): (r.as_kind, r.attempt) for r in some}
        rows = docs.withColumn("__own", F.lit(None).cast("array<struct<kind:string,canon:string,as_kind:string,attempt:int>>"))
    else:
        known = {}
        of = mentions.join(retried, ["kind", "canon"]).groupBy(F.col("k").alias("__k"))
        of = of.agg(F.collect_set(F.struct("kind", "canon", "as_kind", "attempt")).alias("__own"))
        rows = docs.join(of, F.xxhash64(text_col) == F.col("__k"), "left")
    made = rows.withColumn("__made", F.pandas_udf(_rewrite(key, known), RESULT)(F.col(text_col), F.col("__own")))
    columns = [F.col("__made.text").alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return made.select(*columns, F.col("__made.n").alias("__n_entities"), F.col("__made.spans").alias("__spans"))
