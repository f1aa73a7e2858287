"""SentencePiece encoding and decoding (4) for merge-type vocabularies, by an agenda of adjacent symbol pairs.

A text gets the dummy prefix, its spaces become the space symbol, and the pair whose piece has the highest score is
merged first, the leftmost first among equals, until no adjacent pair is a piece. Characters without a piece fall back
to their UTF-8 bytes. Texts are cut where no piece can span the cut, so each distinct chunk is encoded once in a
worker; each new chunk's ids and decoding are checked against the sentencepiece library within the same Arrow batch, and
a difference raises.

Null text is treated as empty: no ids, empty decoding. Long texts are chunked like any other; repeated rows are each
encoded; other columns pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digest, resident, struct, table, text_batches, text_rows

SPACE = "▁"
#: Distinct chunks that a worker remembers as recent, and their characters with those of their ids; when they are more, those
#: used since then are kept, and the rest is learned anew.
REMEMBERED, CHARACTERS = 400_000, 12_000_000
#: Characters of texts whose new chunks are learned together.
BLOCK = 200_000
#: Symbols up to which a list is a faster agenda than a heap.
FEW = 48
NEVER = float("inf")


class Codec:
    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        self.piece = [sp.id_to_piece(i) for i in ids]
        self.byte = {i: int(self.piece[i][1:-1], 16) for i in ids if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte.items()}
        self.id = {self.piece[i]: i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.rank = {p: -sp.get_score(i) for p, i in self.id.items()}
        self.shown = [None if sp.is_byte(i) else "" if sp.is_control(i) else self.piece[i].replace(SPACE, " ") for i in ids]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) or ("\n" in p and p != "\n") for p in self.id):
            raise ValueError("a piece spans what is cut at: this vocabulary has pieces over more than one word")
        bare = f" *{LETTER}++(?:{separable(self.id)})|"
        #: Chunks have plain spaces, which take a third of the bytes of the space symbol or less
        self.chunks = re.compile(f"{bare} *[^ \n]+| +|\n").findall
        #: A chunk's ids in decimal, joined by commas
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.characters = 0
        #: The decoding of those known chunks that aren't decoded to themselves
        self.differs: dict[str, str] = {}

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk by the agenda of its adjacent pairs."""
        out: list[int] = []
        for s in self.merged_few(chunk) if len(chunk) <= FEW else self.merged_many(chunk):
            if (i := self.id.get(s)) is not None:
                out.append(i)
            else:
                out += [self.byte_id[b] for b in s.encode()]
        return out

    def merged_few(self, chunk: str) -> list[str]:
        """The agenda as a list of ranks in place: its least, the leftmost one among equals, is the next pair."""
        rank, symbols = self.rank.get, list(chunk)
        agenda = [rank(chunk[i : i + 2], NEVER) for i in range(len(chunk) - 1)]
        while agenda and (least := min(agenda)) is not NEVER:
            i = agenda.index(least)
            symbols[i] = pair = symbols[i] + symbols.pop(i + 1)
            agenda.pop(i)
            if i < len(agenda):
                agenda[i] = rank(pair + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + pair, NEVER)
        return symbols

    def merged_many(self, chunk: str) -> Iterable[str]:
        """The agenda as a heap, for long chunks; a merged pair leaves its right symbol empty."""
        rank, symbols, n = self.rank.get, list(chunk), len(chunk)
        before, after = list(range(-1, n)), list(range(1, n + 2))
        agenda = [(r, i, i + 1, pair) for i in range(n - 1) if (r := rank(pair := chunk[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, pair = heapq.heappop(agenda)
            if after[left] != right or not symbols[right] or symbols[left] + symbols[right] != pair:
                continue  # one of the two has been merged meanwhile
            symbols[left], symbols[right] = pair, ""
            after[left] = follows = after[right]
            before[follows] = left
            if follows < n and (r := rank(wider := pair + symbols[follows])) is not None:
                heapq.heappush(agenda, (r, left, follows, wider))
            if (earlier := before[left]) >= 0 and (r := rank(wider := symbols[earlier] + pair)) is not None:
                heapq.heappush(agenda, (r, earlier, left, wider))
        return filter(None, symbols)

    def text_of(self, ids: list[int]) -> str:
        """Pieces with their spaces, byte pieces joined into characters; the space of the dummy prefix is still there."""
        shown = [self.shown[i] for i in ids]
        if None not in shown:
            return "".join(shown)
        out, run = [], bytearray()
        for i, text in zip(ids, shown, strict=True):
            if text is None:
                run.append(self.byte[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            out.append(text)
        return "".join(out) + run.decode(errors="replace")

    def decode(self, ids: list[int]) -> str:
        return self.text_of(ids).removeprefix(" ") if ids and ids[0] not in self.byte else self.text_of(ids)

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks that are new here, checking each against the library; chunks that aren't used for long are forgotten."""
        if len(self.known) > REMEMBERED or self.characters > CHARACTERS:
            self.older, self.known, self.characters = self.known, {}, 0
            self.differs = {c: self.differs[c] for c in self.differs if c in self.older}
        new = []
        for c in chunks.difference(self.known):
            if (ids := self.older.pop(c, None)) is not None:
                self.known[c] = ids
                self.characters += len(c) + len(ids)
            else:
                new.append(c)
        symbols = [c.replace(" ", SPACE) for c in new]
        # The library puts a space before each text; behind a line end, which is a token of its own, chunks stand as they are
        theirs = [ids[2:] for ids in self.library.encode(["\n" + s for s in symbols], num_threads=1)]
        back = self.library.decode(theirs, num_threads=1)
        for c, s, ids, text in zip(new, symbols, theirs, back, strict=True):
            own = self.merge(s)
            shown = self.text_of(own)
            if own != ids or (shown[1:] if s[0] == SPACE else shown) != text:
                raise ValueError(f"not as the library has it: {c!r}")
            self.known[c] = joined = ",".join(map(str, own))
            self.characters += len(c) + len(joined)
            if shown != c:
                self.differs[c] = shown

    def parts(self, texts: Iterable[str | None]) -> Iterator[tuple[list[str], str]]:
        """Of each text, the ids of each chunk, in decimal joined by commas, and the decoding of all, behind the space of the dummy prefix.

        Texts are taken in blocks, whose new chunks are learned at once.
        """
        for block in self.blocks(texts):
            self.learn(set().union(*block))
            for chunks in block:
                as_is = self.differs.keys().isdisjoint(chunks)
                yield list(map(self.known.__getitem__, chunks)), "".join(chunks if as_is else [self.differs.get(c, c) for c in chunks])

    def blocks(self, texts: Iterable[str | None]) -> Iterator[list[list[str]]]:
        """The chunks of texts, in blocks of about BLOCK characters."""
        block, held = [], 0
        for text in texts:
            block.append(self.chunks(" " + text.replace(SPACE, " ")) if text else [])
            held += len(text or "")
            if held >= BLOCK:
                yield block
                block, held = [], 0
        if block:
            yield block

    def encode(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        for parts, _ in self.parts(texts):
            yield [int(i) for ids in parts for i in ids.split(",")]


LETTER = r"[^\W\d_]"


def separable(pieces: Iterable[str]) -> str:
    """A pattern of places behind letters where texts can be cut: before ASCII marks, but for letters that a piece joins to them."""
    joined: dict[str, set[str]] = {c: set() for c in map(chr, range(33, 127)) if not c.isalnum()}
    for p in pieces:
        for pair in re.findall(f"(?=({LETTER}.))", p):
            if pair[1] in joined:
                joined[pair[1]].add(pair[0])
    return "|".join(f"(?={re.escape(c)})" + (f"(?<![{''.join(sorted(letters))}])" if letters else "") for c, letters in joined.items())


def _codec(key: str, model) -> Codec:
    return resident(key, lambda: Codec(model.value))


def _shared(spark: SparkSession, model_path: str):
    text_batches(spark)
    with open(model_path, "rb") as f:
        content = f.read()
    return digest(content), spark.sparkContext.broadcast(content)  # bounded by the vocabulary


def encode(text: Column, spark: SparkSession, model_path: str) -> Column:
    """Ids of each text as array<int>, without begin or end ids."""
    key, model = _shared(spark, model_path)

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        codec = _codec(key, model)
        return pa.array(list(codec.encode(text_rows(texts))), pa.list_(pa.int32()))

    return encoded(text)


def decode(ids: Column, spark: SparkSession, model_path: str) -> Column:
    """The text of each array of ids; null gives the empty text."""
    key, model = _shared(spark, model_path)

    @F.arrow_udf("string")
    def decoded(rows: pa.Array) -> pa.Array:
        codec = _codec(key, model)
        return pa.array([codec.decode(r or []) for r in text_rows(rows)], pa.string())

    return decoded(ids)


def round_trip(text: Column, spark: SparkSession, model_path: str) -> Column:
    """struct<n_tokens, ids_sha256, decoded, decoded_sha256> of each text: encoded, then decoded from its ids."""
    key, model = _shared(spark, model_path)

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded:string,decoded_sha256:string>")
    def there_and_back(texts: pa.Array) -> pa.Array:
        codec = _codec(key, model)
        n, ids, texts_out, digests = [], [], [], []
        for parts, shown in codec.parts(text_rows(texts)):
            joined = ",".join(parts)
            n.append(joined.count(",") + 1 if parts else 0)
            ids.append(hashlib.sha256(joined.encode()).hexdigest())
            texts_out.append(shown.removeprefix(" "))
            digests.append(hashlib.sha256(texts_out[-1].encode()).hexdigest())
        return struct(n_tokens=(n, pa.int64()), ids_sha256=(ids, pa.string()), decoded=(texts_out, pa.string()), decoded_sha256=(digests, pa.string()))

    return there_and_back(text)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", round_trip(F.col("text"), spark, model_path()).alias("r"))
    return docs.select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")
