"""Op 1: personal data replaced by keyed, type-consistent surrogates.

Found are e-mail and IP addresses, phone, card, social-security and account
numbers, credentials, and names after a title. Each entity has a canonical form
(case and punctuation left out), so that all its mentions, in any document, get
one surrogate: coreference. The surrogate is a keyed permutation of the canonical
form within its class (a Feistel network over the characters' alphabets): letters stay
letters of their script, vowels of a name stay vowels and its last letter stays, which
keeps the gender its ending and title show; digits stay digits, a valid check digit
stays valid, a private address stays private. The mention's case and punctuation are
then put back. A permutation never sends two entities of a class to one surrogate.

Collision check: surrogates are also compared with all real entities of the corpus
and with each other, by joins; those that clash are drawn again under the next tweak
until none is left (at most ROUNDS times, for classes as small as their members).
Documents with a redrawn entity get it by a join; all others need no lookup.

Defined cases: null text stays null, with no entity; a null or empty text, a
repeated row or a very long text is no special case; extra columns stay, but for
n_entities, which is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titerloom.llm.common import join_rows, materialize, text_hash

ROUNDS = 20
FEISTEL = 8
#: Titles that a name follows.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau M Mme Mlle Monsieur Madame Señor Señora Sr Sra г-н г-жа господин госпожа κύριος κυρία".split()
#: Alphabets, by which a character is replaced within its own: vowels and consonants, script by script.
NAME_ALPHABETS = ("aeiouy", "bcdfghjklmnpqrstvwxz", "áàâäéèêëíìîïóòôöúùûü", "ñçß", "аеиоуыэюя", "бвгдёжзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρσςτφχψ")
LETTERS, DIGITS, HEXES = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"

_LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})$")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}")
_NUMBERS = re.compile(
    r"(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<phone>(?<![\w+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-]))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b)"
    r"|(?P<key>\bAKIA[0-9A-Z]{16}\b)"
    r"|(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b[ ]*[=:][ ]*[\"']?)(?P<secret>[0-9A-Za-z_+/-]{6,})"
)
_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_TITLED = re.compile(rf"(?<!\w)(?i:{'|'.join(map(re.escape, TITLES))})\.?[ ](?P<name>{_NAME}(?:[ ]{_NAME}){{0,2}})")


def find(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the entities, in order, none over another."""
    out: list[tuple[int, int, str]] = []
    at = text.find("@")
    while at >= 0:
        left, right = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
        if left and right:
            out.append((left.start(), right.end(), "email"))
        at = text.find("@", at + 1)
    if any(d in text for d in DIGITS):
        out += [(m.start(m.lastgroup), m.end(m.lastgroup), m.lastgroup) for m in _NUMBERS.finditer(text) if m.lastgroup != "ip" or all(int(x) < 256 for x in m.group().split("."))]
    low = text.lower()
    if any(t.lower() in low for t in TITLES if t != "M") or "M. " in text:
        names = set()
        for m in _TITLED.finditer(text):
            a = m.start("name")
            for part in re.finditer(_NAME, m.group("name")):
                if not part.group()[0].isupper():
                    break
                names.add(part.group())
                out.append((a + part.start(), a + part.end(), "name"))
        for name in {n.lower() for n in names}:  # other mentions, without the title or in other case
            out += [(m.start(), m.end(), "name") for m in re.finditer(rf"(?<!\w)(?i:{re.escape(name)})(?!\w)", text) if m.group()[0].isupper()]
    out.sort(key=lambda e: (e[0], -e[1]))
    kept: list[tuple[int, int, str]] = []
    for e in out:
        if not kept or e[0] >= kept[-1][1]:
            kept.append(e)
    return kept


def canonical(kind: str, mention: str) -> str:
    """The same for all mentions of an entity."""
    if kind in ("phone", "card", "ssn"):
        return "".join(c for c in mention if c.isdigit())[-10 if kind == "phone" else -19 :]
    if kind == "iban":
        return mention.replace(" ", "")
    return mention.lower() if kind in ("email", "name") else mention


def _permuted(text: str, alphabets: list[str | None], key: bytes, tweak: str) -> str:
    """Each character moved within its alphabet (None: left), as one keyed permutation."""
    at = [i for i, a in enumerate(alphabets) if a]
    halves = [at[0::2], at[1::2]]
    value, size = [0, 0], [1, 1]
    for h in (0, 1):
        for i in halves[h]:
            value[h] = value[h] * len(alphabets[i]) + alphabets[i].index(text[i])
            size[h] *= len(alphabets[i])
    shape = f"{tweak}|{''.join(c if not a else a[0] for c, a in zip(text, alphabets, strict=True))}"
    for r in range(FEISTEL):
        h = r % 2
        digest = hashlib.blake2b(f"{shape}|{r}|{value[1 - h]}".encode(), key=key, digest_size=32).digest()
        value[h] = (value[h] + int.from_bytes(digest, "big")) % size[h]
    out = list(text)
    for h in (0, 1):
        for i in reversed(halves[h]):
            value[h], d = divmod(value[h], len(alphabets[i]))
            out[i] = alphabets[i][d]
    return "".join(out)


def _alphabet(c: str, sets: tuple[str, ...]) -> str | None:
    return next((s for s in sets if c in s), None)


def _luhn(digits: str) -> int:
    """The check digit that follows digits."""
    total = sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def surrogate(kind: str, value: str, key: bytes, tweak: int = 0) -> str:
    """A canonical form for a canonical form: one to one within a kind, format and tweak."""
    t = f"{kind}|{tweak}"
    if kind == "name":
        sets = [_alphabet(c, NAME_ALPHABETS) for c in value]
        return _permuted(value, sets[:-1] + [None], key, t) if len(value) > 2 else _permuted(value, sets, key, t)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        name, _, top = domain.rpartition(".")
        sets = (LETTERS, DIGITS)
        moved = [_permuted(x, [_alphabet(c, sets) for c in x], key, t + w) for x, w in ((local, "local"), (name, "domain"))]
        return f"{moved[0]}@{moved[1]}.{top}"
    if kind == "ip":
        n = [int(x) for x in value.split(".")]

        def class_of(a: list[int]) -> tuple:
            return (a[0] == 10, a[0] == 127, a[0] == 0 or a[0] >= 224, a[:2] == [192, 168], a[0] == 172 and 16 <= a[1] < 32)

        text, was = "%02x%02x%02x%02x" % tuple(n), class_of(n)
        for _ in range(1 << 20):  # walk the permutation's cycle back into the class
            text = _permuted(text, [HEXES] * 8, key, t)
            n = [int(text[i : i + 2], 16) for i in (0, 2, 4, 6)]
            if class_of(n) == was:
                break
        return ".".join(map(str, n))
    if kind == "card":
        if int(value[-1]) == _luhn(value[:-1]):
            body = _permuted(value[:-1], [None] + [DIGITS] * (len(value) - 2), key, t)
            return body + str(_luhn(body))
        while True:
            value = _permuted(value, [None] + [DIGITS] * (len(value) - 1), key, t)
            if int(value[-1]) != _luhn(value[:-1]):
                return value
    if kind == "iban":
        body = value[:4] + _permuted(value[4:], [_alphabet(c, (LETTERS.upper(), DIGITS)) for c in value[4:]], key, t + value[:2])
        number = int("".join(str(int(c, 36)) for c in body[4:] + body[:2] + "00"))
        return f"{body[:2]}{98 - number % 97:02d}{body[4:]}"
    if kind == "key":
        return value[:4] + _permuted(value[4:], [_alphabet(c, (LETTERS.upper(), DIGITS)) for c in value[4:]], key, t)
    if kind == "secret" and all(c in HEXES for c in value):
        return _permuted(value, [HEXES] * len(value), key, t)
    return _permuted(value, [_alphabet(c, (LETTERS, LETTERS.upper(), DIGITS)) for c in value], key, t)


def rendered(kind: str, mention: str, value: str) -> str:
    """value in the mention's case and punctuation."""
    if kind in ("ip", "key", "secret"):
        return value
    if kind in ("email", "name"):
        return "".join(v.upper() if m.isupper() and len(v.upper()) == 1 else v for m, v in zip(mention, value, strict=True)) if len(mention) == len(value) else value
    slots = [i for i, c in enumerate(mention) if c.isalnum()][-len(value) :]
    out = list(mention)
    for i, v in zip(slots, value, strict=True):
        out[i] = v
    return "".join(out)


def rewritten(text: str | None, key: bytes, redrawn: dict[tuple[str, str], str]) -> tuple[str | None, int]:
    if not text:
        return text, 0
    entities, out, at = find(text), [], 0
    for start, end, kind in entities:
        mention = text[start:end]
        value = canonical(kind, mention)
        out += [text[at:start], rendered(kind, mention, redrawn.get((kind, value)) or surrogate(kind, value, key))]
        at = end
    return "".join([*out, text[at:]]), len(entities)


def _entities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: dict[tuple[str, str], int] = {}
        for text in batch["text"]:
            for start, end, kind in find(text or ""):
                k = (kind, canonical(kind, text[start:end]))
                counts[k] = counts.get(k, 0) + 1
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["kind", "value", "n"])


def assign(docs: DataFrame, key: bytes, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """All entities (kind, value, mentions), and those redrawn (kind, value, surrogate)."""
    found = docs.select("text").mapInPandas(_entities, "kind string, value string, n long")
    entities = materialize(found.groupBy("kind", "value").agg(F.sum("n").alias("mentions")), "entities")

    @F.pandas_udf("string")
    def drawn(kind: pd.Series, value: pd.Series, tweak: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, v, key, t) for k, v, t in zip(kind, value, tweak, strict=True)], dtype=object)

    real = entities.select("kind", F.col("value").alias("surrogate"))
    given = materialize(entities.select("kind", "value", F.lit(0).alias("tweak")).withColumn("surrogate", drawn("kind", "value", "tweak")), "surrogates")
    for _ in range(rounds):
        twice = given.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("keeper")).where("n > 1").drop("n")
        clash = given.join(real, ["kind", "surrogate"], "left_semi").select("kind", "value").unionByName(given.join(twice, ["kind", "surrogate"]).where("value != keeper").select("kind", "value")).distinct()
        clash = materialize(clash.withColumn("clash", F.lit(True)), "clashes")
        if not clash.limit(1).count():
            break
        marked = given.join(clash, ["kind", "value"], "left").withColumn("tweak", F.col("tweak") + F.coalesce(F.col("clash").cast("int"), F.lit(0)))
        again = marked.where("clash").withColumn("surrogate", drawn("kind", "value", "tweak"))
        given = materialize(marked.where("clash is null").unionByName(again).drop("clash"), "surrogates")
    return entities, given.where("tweak > 0").select("kind", "value", "surrogate")


def replace_entities(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with each entity of text replaced, and n_entities, their number."""
    _, redrawn = assign(docs, key)
    kept = [c for c in docs.columns if c.lower() not in ("n_entities", "thash", "__r", "__map")]
    rows = docs.select(*kept)
    if redrawn.limit(1).count():

        def mentioned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = [(i, h, k, canonical(k, t[a:b])) for i, h, t in zip(batch["doc_id"], batch["thash"], batch["text"], strict=True) for a, b, k in find(t or "")]
                yield pd.DataFrame(out, columns=["doc_id", "thash", "kind", "value"]).drop_duplicates()

        id_type = dict(docs.dtypes)["doc_id"]
        mentions = docs.select("doc_id", text_hash().alias("thash"), "text").mapInPandas(mentioned, f"doc_id {id_type}, thash long, kind string, value string")
        maps = mentions.join(redrawn, ["kind", "value"]).groupBy("doc_id", "thash").agg(F.collect_set(F.struct("kind", "value", "surrogate")).alias("__map"))
        rows = join_rows(rows.withColumn("thash", text_hash()), maps, "left").drop("thash")
    else:
        rows = rows.withColumn("__map", F.lit(None).cast("array<struct<kind:string,value:string,surrogate:string>>"))

    @F.pandas_udf("text string, n long")
    def run(texts: pd.Series, maps: pd.Series) -> pd.DataFrame:
        out = []
        for text, known in zip(texts, maps, strict=True):
            redraw = {(m["kind"], m["value"]): m["surrogate"] for m in known} if known is not None else {}
            out.append(rewritten(text, key, redraw))
        return pd.DataFrame(out, columns=["text", "n"])

    done = rows.withColumn("__r", run("text", "__map"))
    return done.select(*[F.col("__r.text").alias("text") if c == "text" else F.col(c) for c in kept], F.col("__r.n").alias("n_entities"))
