"""Op 3: byte-pair encoding as a bounded-lookahead streaming transducer, and decoding.

Encoding. The tokens of a prefix are fixed by each position's last token, and two
tokens may stand side by side exactly if merging their symbols never joins across
their border. So symbols can be read one by one: a new symbol's last token is the
longest one that may follow what its start's prefix ends with. What later symbols
can still change hangs on the positions at which a longer token could have begun;
the tokens that all those positions' histories share are stable and leave at
once, which is looked into every CHECK symbols. The state is the last stable token
and the symbols after it, at most CHECK plus ``sufficient_lookahead(merges)`` of them,
however long the text. Short pieces seen lately are remembered, a bounded number.

Decoding. ``Decoder`` turns tokens to bytes and bytes to text through a UTF-8 state
machine that holds an unfinished sequence of at most three bytes. The digest of the decoded
text is of what it makes of the emitted ids. A tokenizer file without a decoder has its
tokens' strings as text, with a space between two.

Defined cases: null text is the empty text (no tokens; digests of the empty
string); an empty table has no rows; texts are streamed piece by piece, and pieces beyond
LONG characters token by token, so a very long one holds no token list; repeated rows are
encoded each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titerloom.llm.common import kept_by_worker, releasing, small_batches

END = "</w>"
#: Entries of each memo; a full one is emptied, that of chunks and pieces at its second turn.
MEMO = 200_000
#: The same of the memo of beginnings, whose entries are the largest.
MEMO_BEGUN = 80_000
#: Symbols held before stable tokens are looked for.
CHECK = 64
#: Characters of a piece beyond which it is streamed and not remembered.
LONG = 256
#: Symbols after which a piece's state is remembered, for the pieces that begin alike.
BEGINNINGS = (10, 8, 6, 5, 4)
#: Characters of a text that are cut into pieces at once.
SLICE = 1 << 16
#: White space as Unicode has it; the control characters 1C to 1F don't count.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Pieces of a lowered text that are encoded each on its own; L, N: letters, numbers.
PIECE = r"[{L}]+|[{N}]|'s|'t|'re|'ve|'m|'ll|'d|[^{SPACE}{L}{N}]+"
#: Letters and numbers of Unicode 16, which the library knows and Python 3.13 doesn't.
NEW_LETTERS = "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b-1138b 1138e-1138e 11390-113b5 113b7-113b7 113d1-113d1 113d3-113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff-18cff 1e5d0-1e5ed 1e5f0-1e5f0"
NEW_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
#: Characters that Python composes and lowers as the library does: no combining marks, and old letters.
PLAIN = "\u0000-\u02ff\u0370-\u0482\u048a-\u052f\u2010-\u2027\u3000-\u3029\u3041-\u3096\u30a0-\u30ff\u4e00-\u9fff"
#: The same for lowered ASCII texts, most frequent first; quicker.
ASCII_PIECE = r"[a-z]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\t-\r a-z0-9]+"


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself if printable, else the next from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def character_class(kind: str, more: str) -> str:
    """The ranges of a regular expression's class: characters of a Unicode category's first
    letter, and the ranges in `more`."""
    of = bytearray(unicodedata.category(chr(c))[0] == kind for c in range(0x110000))
    for low, high in (r.split("-") for r in more.split()):
        of[int(low, 16) : int(high, 16) + 1] = b"\x01" * (int(high, 16) - int(low, 16) + 1)
    return "".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in re.finditer(b"\x01+", bytes(of)))


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols past a border after which nothing can move it: the longest token times the
    longest chain of merges (x, a), (a, b), ... in which each, done earlier than the one
    before, takes away that one's right part."""
    chain: dict[str, int] = {}
    longest = depth = 1
    for left, right in merges:
        d = 1 + chain.get(right, 0)
        chain[left] = max(chain.get(left, 0), d)
        depth = max(depth, d)
        longest = max(longest, len(left.removesuffix(END)) + len(right.removesuffix(END)))
    return longest * depth


class Transducer:
    """Encodes one piece at a time, symbol by symbol."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.parts = {}
        for pair in merges:
            self.parts.setdefault(pair[0] + pair[1], pair)
        self.lookahead = sufficient_lookahead(merges)
        self.fits: dict[tuple[str, str], bool] = {}
        #: The same by left token, for short pieces, and its entries.
        self.followers: dict[str | None, dict[str, bool]] = {}
        self.n_followers = 0
        self.spines: tuple[dict[str, list[tuple[str, float]]], ...] = ({}, {})
        self.begun: dict[str, tuple[list[str], list[int]]] = {}  # states after frequent beginnings
        self.held = 0  # most symbols held so far
        self.whole: dict[str, bool] = {}
        #: Of a string of symbols: 1 a token that its symbols do merge to, 2 the start of a longer one.
        self.kinds: dict[str, int] = {}
        for token in vocab:
            if self.is_token(token):
                self.kinds[token] = 1
        for token in vocab:
            body = token.removesuffix(END) or token
            for k in range(1, len(body)):
                self.kinds[body[:k]] = self.kinds.get(body[:k], 0) | 2

    def _spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """(piece, rank of the merge that uses it up) along one edge, the smallest first."""
        known = self.spines[side].get(token)
        if known is None:
            out, used, piece = [], float("inf"), token
            while True:
                out.append((piece, used))
                if piece not in self.parts:
                    break
                used = self.rank[self.parts[piece]]
                piece = self.parts[piece][side]
            # Of tokens only, so there are no more of them than twice the vocabulary.
            known = self.spines[side][token] = out[::-1]
        return known

    def may_follow(self, left: str, right: str) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            known = self.fits[(left, right)] = self._fits(left, right)
        return known

    def _fits(self, left: str, right: str) -> bool:
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        while True:
            (x, x_used), (y, y_used) = a[i], b[j]
            rank = self.rank.get((x, y), float("inf"))
            # Of equal merges the left one comes first.
            if rank < x_used and rank <= y_used and rank != float("inf"):
                return False
            if x_used == y_used == float("inf"):
                return True
            if x_used <= y_used:
                i += 1
            else:
                j += 1

    def is_token(self, token: str) -> bool:
        """In the vocabulary, and what its own symbols merge to."""
        known = self.whole.get(token)
        if known is None:
            known = token in self.vocab and (token not in self.parts or all(map(self.is_token, self.parts[token])) and self._joins(*self.parts[token]))
            if len(token.removesuffix(END)) > 1 and token not in self.parts:
                known = False
            self.whole[token] = known
        return known

    def _joins(self, left: str, right: str) -> bool:
        """No merge across the border comes before the one that joins left and right."""
        a, b, at = self._spine(left, 1), self._spine(right, 0), self.rank[(left, right)]
        i = j = 0
        while True:
            (x, x_used), (y, y_used) = a[i], b[j]
            rank = self.rank.get((x, y), float("inf"))
            if (x, y) != (left, right) and rank < x_used and rank <= y_used and rank < at:
                return False
            if x_used == y_used == float("inf"):
                return True
            if x_used <= y_used:
                i += 1
            else:
                j += 1

    def _stable(self, borders: list[int], last: list[str]) -> int:
        """Symbols held whose tokens no later symbol can change: as far as the histories of
        all positions agree at which a token still to come may begin."""
        common: set[int] | None = None
        for q in borders:
            history = {q}
            while q:
                q -= len(last[q - 1])
                history.add(q)
            common = history if common is None else common & history
        return max(common or {0})

    def encode(self, symbols: str) -> Iterator[str]:
        """Tokens of one piece, each soon after it is stable."""
        if len(symbols) <= CHECK:
            yield from self.encode_short(symbols)
            return
        kinds, fits = self.kinds.get, self.fits
        prev, base, end = None, 0, len(symbols) - 1
        last: list[str] = []  # of each prefix that ends after base, its last token
        live: list[int] = []  # where a token that isn't complete yet may have begun
        begin = 0
        for k in BEGINNINGS:
            if end >= k and (known := self.begun.get(symbols[:k])):
                begin, last, live = k, known[0].copy(), known[1].copy()
                break
        for i in range(begin, end):
            live.append(i)
            kept, hit = [], None
            for j in live:  # the longest first
                token = symbols[j : i + 1]
                kind = kinds(token)
                if kind is None:
                    continue
                if kind > 1:
                    kept.append(j)
                if hit is None and kind & 1:
                    before = last[j - base - 1] if j > base else prev
                    if before is None:
                        hit = token
                    elif (fit := fits.get((before, token))) or fit is None and self.may_follow(before, token):
                        hit = token
            live = kept
            last.append(hit)
            if i + 1 in BEGINNINGS:
                if len(self.begun) >= MEMO_BEGUN:
                    self.begun.clear()
                self.begun[symbols[: i + 1]] = (last.copy(), live.copy())
            if len(last) >= CHECK:
                self.held = max(self.held, len(last))
                cut = self._stable([*(j - base for j in live), len(last)], last)
                if not cut and len(last) >= CHECK + self.lookahead:
                    # By the bound, what is as old as the lookahead is stable.
                    cut = len(last)
                    while cut > len(last) - self.lookahead:
                        cut -= len(last[cut - 1])
                if cut:
                    yield from (out := self._chain(last, cut))
                    prev, base, last = out[-1], base + cut, last[cut:]
        # The last symbol bears the end mark.
        for j in (*live, end):
            token = symbols[j:] + END
            if (kinds(token) or 0) & 1:
                before = last[j - base - 1] if j > base else prev
                if before is None or self.may_follow(before, token):
                    yield from self._chain(last, j - base)
                    yield token
                    return

    def encode_short(self, symbols: str) -> list[str]:
        """encode() of at most CHECK symbols, of which none is given out before the last."""
        kinds, fits, end = self.kinds.get, self.fits_after, len(symbols) - 1
        last: list[str | None] = []
        after: list[dict[str, bool]] = []  # of each prefix, what is known to follow its last token
        live: list[int] = []
        begin = 0
        for k in BEGINNINGS:
            if end >= k and (known := self.begun.get(symbols[:k])):
                begin, last, live = k, known[0].copy(), known[1]
                after = [fits(t) for t in last]
                break
        for i in range(begin, end):
            kept, hit, to = [], None, i + 1
            for j in (*live, i):  # the longest first
                token = symbols[j:to]
                if kind := kinds(token):
                    if kind > 1:
                        kept.append(j)
                    if hit is None and kind & 1:
                        if not j:
                            hit = token
                        elif (fit := after[j - 1].get(token)) or fit is None and self.follows(last[j - 1], token):
                            hit = token
            live = kept
            last.append(hit)
            after.append(fits(hit))
            if to in BEGINNINGS:
                if len(self.begun) >= MEMO_BEGUN:
                    self.begun.clear()
                self.begun[symbols[:to]] = (last.copy(), live)
        # The last symbol bears the end mark.
        for j in (*live, end):
            token = symbols[j:] + END
            if (kinds(token) or 0) & 1:
                if not j:
                    return [token]
                if (fit := after[j - 1].get(token)) or fit is None and self.follows(last[j - 1], token):
                    return [*self._chain(last, j), token]
        return []

    def fits_after(self, token: str | None) -> dict[str, bool]:
        known = self.followers.get(token)
        if known is None:
            known = self.followers[token] = {}
        return known

    def follows(self, left: str, right: str) -> bool:
        """may_follow(), entered by the left token."""
        if self.n_followers >= 2 * MEMO:
            for known in self.followers.values():  # those that a piece at hand holds, too
                known.clear()
            self.n_followers = 0
        self.n_followers += 1
        known = self.fits_after(left)[right] = self._fits(left, right)
        return known

    def _chain(self, last: list[str], to: int) -> list[str]:
        """The tokens of the held prefix of `to` symbols."""
        out = []
        while to:
            out.append(last[to - 1])
            to -= len(last[to - 1])
        return out[::-1]


class Decoder:
    """Tokens to text, a token at a time; holds an unfinished UTF-8 sequence only. plain: the
    tokenizer names no decoder, so that tokens are text themselves, with a space between two."""

    def __init__(self, tokens: dict[int, str], added: dict[str, int], plain: bool = False):
        self.tokens, self.special, self.plain = tokens, set(added.values()), plain
        self.bytes = {c: b for b, c in enumerate(byte_alphabet())}
        self.pending, self.need, self.begun = bytearray(), 0, False

    def _flush(self) -> str:
        out = "�" if self.pending else ""
        self.pending.clear()
        self.need = 0
        return out

    def _byte(self, b: int) -> str:
        if self.need:
            low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(self.pending[0], (0x80, 0xBF)) if len(self.pending) == 1 else (0x80, 0xBF)
            if low <= b <= high:
                self.pending.append(b)
                self.need -= 1
                if self.need:
                    return ""
                out = self.pending.decode()
                self.pending.clear()
                return out
            return self._flush() + self._byte(b)
        if b < 0x80:
            return chr(b)
        self.need = 1 if 0xC2 <= b <= 0xDF else 2 if 0xE0 <= b <= 0xEF else 3 if 0xF0 <= b <= 0xF4 else 0
        if not self.need:
            return "�"
        self.pending.append(b)
        return ""

    def feed(self, token_id: int) -> str:
        """The text this token completes; a word's end becomes a space."""
        token = self.tokens[token_id]
        if self.plain:
            space, self.begun = " " if self.begun else "", True
            return space + "".join(map(self._byte, token.encode()))
        if token_id in self.special:
            return self._flush() + token
        word_end = token.endswith(END)
        out = "".join(self._byte(self.bytes[c]) for c in (token[: -len(END)] if word_end else token))
        return out + (self._flush() + " " if word_end else "")

    def finish(self) -> str:
        self.begun = False
        return self._flush()


class Encoder:
    """Texts to tokens by a tokenizer file of the word-end kind, and back."""

    def __init__(self, path: str):
        from tokenizers import normalizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab = model["vocab"]
        self.tokens = {i: t for t, i in {**self.vocab, **self.added}.items()}
        self.plain = spec["decoder"] is None
        self.transducer = Transducer(self.vocab, merges)
        self.letters = byte_alphabet()
        classes = {"SPACE": SPACE, "L": character_class("L", NEW_LETTERS), "N": character_class("N", NEW_NUMBERS)}
        self.pieces = re.compile(re.sub(r"\{(\w+)\}", lambda m: classes[m[1]], PIECE))
        self.ascii_pieces = re.compile(ASCII_PIECE)
        #: No piece reaches over white space; 1C to 1F are white space in Python alone.
        self.chunk = re.compile(f"[^{SPACE}]+")
        self.separators = re.compile("[\x1c-\x1f]")
        self.rare = re.compile(f"[^{PLAIN}]")
        #: For rare characters the library's own tables, which are newer than Python's.
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.split = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        #: Ids, joined by spaces, of the chunks and pieces met lately, and of those before them.
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        #: Decodes the ids of one piece, at whose end no byte is pending.
        self.decoder = Decoder(self.tokens, self.added, plain=True)
        #: Of each token met its id as text; of each such text what the decoder makes of the id.
        self.id_texts: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    def learn(self, piece: str) -> str:
        """Enter a piece's ids, joined by spaces."""
        ids = self.older.get(piece)
        if ids is None:
            symbols = self.symbols(piece)
            ids = self.joined(self.transducer.encode_short(symbols) if len(symbols) <= CHECK else list(self.transducer.encode(symbols)))
        self.known[piece] = ids
        return ids

    def learn_chunk(self, chunk: str) -> None:
        """The same of a chunk: what stands between white space, one piece or several."""
        ids = self.older.get(chunk)
        if ids is None:
            pieces = (self.ascii_pieces if chunk.isascii() else self.pieces).findall(chunk)
            ids = " ".join([self.known.get(p) or self.learn(p) for p in pieces])
        self.known[chunk] = ids

    def joined(self, tokens: list[str]) -> str:
        """Ids of tokens; what the decoder makes of each is kept."""
        try:
            return " ".join([self.id_texts[t] for t in tokens])
        except KeyError:
            for t in tokens:
                n = self.vocab[t]
                self.id_texts[t] = str(n)
                # Alone, a plain token leaves no byte pending; a space parts it from the next.
                self.decoded[str(n)] = self.decoder.feed(n) + self.decoder.finish()
            return " ".join([self.id_texts[t] for t in tokens])

    def text_of(self, ids: str) -> str:
        """What ids entered by joined() decode to."""
        return " ".join(map(self.decoded.__getitem__, ids.split(" ")))

    def symbols(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable() and " " not in piece:
            return piece  # these stand for themselves
        return "".join(map(self.letters.__getitem__, piece.encode()))

    def lowered(self, part: str) -> str:
        if part.isascii():
            return part.lower()
        if self.rare.search(part):
            return self.normal.normalize_str(part)
        # Lowered letter by letter: a sigma that ends a word is no special case.
        return unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()

    def stream(self, text: str) -> Iterator[tuple[str, str]]:
        """Ids, joined by spaces, and the text they decode to, of a slice of the text at a time."""
        for part in self.split.split(text) if self.split else [text]:
            if part in self.added:
                yield str(self.added[part]), self.decoder.feed(self.added[part]) + self.decoder.finish()
                continue
            low = self.lowered(part)
            if len(self.known) >= MEMO:
                # What was met since the last turn stays for another one.
                self.older, self.known = self.known, {}
            if len(low) <= SLICE and not self.separators.search(low):
                chunks = low.split()
            else:
                chunks = (m.group() for m in self.chunk.finditer(low))
            chunks = iter(chunks)
            while some := list(islice(chunks, SLICE)):
                ids = list(map(self.known.get, some))
                if None in ids:
                    for c in {c for c, i in zip(some, ids, strict=True) if i is None and len(c) <= LONG}:
                        self.learn_chunk(c)
                    ids = [self.known.get(c) if i is None else i for c, i in zip(some, ids, strict=True)]
                for is_long, run in groupby(zip(some, ids, strict=True), lambda x: x[1] is None) if None in ids else [(False, zip(some, ids, strict=True))]:
                    if is_long:
                        for chunk, _ in run:
                            yield from self.stream_chunk(chunk)
                    else:
                        joined = " ".join([i for _, i in run])
                        yield joined, self.text_of(joined)

    def stream_chunk(self, chunk: str) -> Iterator[tuple[str, str]]:
        """The same of a chunk too long to be remembered, a piece at a time."""
        for m in (self.ascii_pieces if chunk.isascii() else self.pieces).finditer(chunk):
            piece = m.group()
            if len(piece) > LONG:
                yield from self.stream_piece(piece)
            else:
                ids = self.known.get(piece) or self.learn(piece)
                yield ids, self.text_of(ids)

    def stream_piece(self, piece: str) -> Iterator[tuple[str, str]]:
        """The same of a piece too long to be remembered, some tokens at a time."""
        tokens = self.transducer.encode(self.symbols(piece))
        while some := [self.vocab[t] for t in islice(tokens, LONG)]:
            yield " ".join(map(str, some)), "".join(map(self.decoder.feed, some)) + self.decoder.finish()

    def ids(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.stream(text) for i in ids.split(" ")]


@kept_by_worker
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)


def digests(enc: Encoder, text: str | None) -> tuple[int, str, str]:
    """n_tokens and the digests of the ids, joined by a space, and of the text decoded from them."""
    if not enc.plain:
        raise ValueError("digests are of a tokenizer without a decoder, whose tokens a space parts")
    ids, strings, n = hashlib.sha256(), hashlib.sha256(), 0
    for a, b in enc.stream(text or ""):
        if n:
            ids.update(b" ")
            strings.update(b" ")
        n += a.count(" ") + 1
        ids.update(a.encode())
        strings.update(b.encode())
    return n, ids.hexdigest(), strings.hexdigest()


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        made = lambda batches: (pd.DataFrame([digests(enc, t) for t in batch], columns=["n_tokens", "ids_sha256", "decoded_sha256"]) for batch in batches)
        yield from releasing(made, encoder)(texts)

    return docs.select("doc_id", run("text").alias("r")).select("doc_id", "r.*")


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """All columns of docs, with the ids of each text and the text decoded from them in
    place of any columns of those names."""

    @F.pandas_udf("ids array<int>, decoded string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in texts:
            ids = [enc.ids(t or "") for t in batch]
            decoded = []
            for row in ids:
                machine = Decoder(enc.tokens, enc.added)
                decoded.append("".join(map(machine.feed, row)) + machine.finish())
            yield pd.DataFrame({"ids": ids, "decoded": decoded})

    kept = [c for c in docs.columns if c.lower() not in ("token_ids", "decoded_text", "__r")]
    return docs.select(*kept, run("text").alias("__r")).select(*kept, F.col("__r.ids").alias("token_ids"), F.col("__r.decoded").alias("decoded_text"))
