"""Byte-level BPE with reuse of content-defined chunks.

A rolling hash over the bytes cuts every text into chunks, so that equal passages give
equal chunks wherever they stand.  Chunks that several places share are encoded once
and their ids and decoded bytes go into a dictionary; a document takes them from there.
Cuts fall anywhere, so the ids around a cut may differ from those of the whole text:
each join is repaired by encoding again from the last word break inside the left chunk
to the first one inside the right chunk, and on to the next chunk where there is none.
At a word break (a visible ASCII character followed by a space or line feed) the
pre-tokenizer always ends a piece, whatever stands around it, so the repaired ids are
those of the whole text exactly.  A dictionary entry whose ids don't have a token
border at its two breaks would contradict that and is encoded in place.

The dictionary travels to all tasks, so its size is bounded: the ``DICTIONARY_CHUNKS``
chunks that save most (bytes times repeats), none longer than ``LONGEST``.  Other
chunks are encoded where they stand, which gives the same ids.  Texts are never
shuffled: the only exchanges carry chunk hashes, and the dictionary's own chunks.

The vocabulary is the JSON file of a byte-level BPE tokenizer (``path`` must exist on
the executors).  Added tokens in a text get their own id, as that library does.

Edge cases: a null text is encoded as an empty one (no ids); texts without word breaks
are encoded whole; repeated rows and null ids give rows like any other; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veladura.llm.common import map_batches, ship

ship(__name__)

#: A chunk ends where the top bits of the rolling hash are zero: one in 1024 bytes.
CUT_BITS, SHORTEST, LONGEST = 10, 256, 16_384
DICTIONARY_CHUNKS = 8192

_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
_BREAK = re.compile(rb"(?<=[\x21-\x7e])(?=[ \n])")


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        # byte-level vocabularies write each byte as a printable character
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        other = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        self.added = {t["content"]: t["id"] for t in given["added_tokens"]}
        ranks = {
            bytes(byte_of[c] for c in token): i
            for token, i in given["model"]["vocab"].items()
            if token not in self.added
        }
        #: Fixed value: the pre-tokenizer of this kind of vocabulary.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding(
            "given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.bytes_of = {i: b for b, i in ranks.items()} | {
            i: c.encode() for c, i in self.added.items()
        }
        names = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4")

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, encoded directly."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = [
            np.array([self.added[p]], "<u4") if p in self.added else self.plain(p)
            for p in self.special.split(text)
            if p
        ]
        return np.concatenate(parts)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per Python worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def cuts(data: bytes) -> list[int]:
    """Chunk borders of a text: 0, the cuts, its length."""
    n = len(data)
    if n < 2 * SHORTEST:
        return [0, n]
    codes = np.frombuffer(data, np.uint8)
    rolling = _GEAR[codes]
    for step in (1, 2, 4, 8, 16):  # sum of the last 32 bytes' values, each shifted by its age
        rolling[step:] = rolling[step:] + (rolling[:-step] << np.uint32(step))
    at = np.flatnonzero(rolling[:-1] >> np.uint32(32 - CUT_BITS) == 0) + 1
    at = at[(codes[at] & 0xC0) != 0x80]  # not inside a character
    out = [0]
    for x in at.tolist():
        if x - out[-1] >= SHORTEST and n - x >= SHORTEST:
            out.append(x)
    return [*out, n]


def breaks(chunk: bytes) -> tuple[int, int] | None:
    """The first and the last word break inside a chunk."""
    first = _BREAK.search(chunk)
    if first is None:
        return None
    last = max(
        (x for x in (_last(chunk, b" "), _last(chunk, b"\n")) if x is not None),
        default=first.start(),
    )
    return (first.start(), last) if last > first.start() else None


def _last(chunk: bytes, blank: bytes) -> int | None:
    at = chunk.rfind(blank)
    while at > 0:
        if 0x21 <= chunk[at - 1] <= 0x7E:
            return at
        at = chunk.rfind(blank, 0, at)
    return None


def chunk_hash(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk) - (1 << 63)


def shared_chunks(docs: DataFrame, most: int = DICTIONARY_CHUNKS) -> DataFrame:
    """``hash, owner, n``: the chunks that save most; ``owner`` is the hash of a text with it."""

    def prepare():
        def run(columns):
            hashes, owners, sizes = [], [], []
            for text in columns["text"]:
                data = (text or "").encode()
                owner = chunk_hash(data)
                borders = cuts(data)
                for a, b in zip(borders, borders[1:]):
                    if SHORTEST <= b - a <= LONGEST:
                        hashes.append(chunk_hash(data[a:b]))
                        owners.append(owner)
                        sizes.append(b - a)
            return {"hash": hashes, "owner": owners, "size": sizes}

        return run

    found = map_batches(docs.select("text"), "hash bigint, owner bigint, size int", prepare)
    counted = found.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n"), F.min("owner").alias("owner"), F.max("size").alias("size")
    )
    saved = F.col("size") * (F.col("n") - 1)
    return counted.filter("n > 1").orderBy(saved.desc(), "hash").limit(most).select("hash", "owner", "n")


def chunk_dictionary(docs: DataFrame, path: str, most: int = DICTIONARY_CHUNKS) -> dict[int, tuple]:
    """Hash to (first break, last break, ids between them); at most ``most`` entries.

    Each chunk is encoded by one task, from one of the texts that hold it.
    """
    chosen = {r["hash"]: r["owner"] for r in shared_chunks(docs, most).collect()}
    if not chosen:
        return {}
    owners = set(chosen.values())

    def prepare():
        seen: set[int] = set()

        def run(columns):
            hashes, chunks = [], []
            for text in columns["text"]:
                data = (text or "").encode()
                owner = chunk_hash(data)
                if owner in owners and len(data) >= SHORTEST:
                    borders = cuts(data)
                    for a, b in zip(borders, borders[1:]):
                        h = chunk_hash(data[a:b])
                        if chosen.get(h) == owner and h not in seen:
                            seen.add(h)
                            hashes.append(h)
                            chunks.append(data[a:b].decode())
            return {"hash": hashes, "chunk": chunks}

        return run

    def encoder():
        c = codec(path)

        def run(columns):
            out = {"hash": [], "first": [], "last": [], "ids": []}
            for h, chunk in zip(columns["hash"], columns["chunk"]):
                between = breaks(chunk.encode())
                if between is None:
                    continue
                first, last = between
                ids = c.plain(chunk)
                ends = np.cumsum([len(c.bytes_of[i]) for i in ids.tolist()])
                i, j = np.searchsorted(ends, (first, last))
                if ends[i] != first or ends[j] != last:
                    continue  # no exact agreement: encoded where it stands
                out["hash"].append(h)
                out["first"].append(first)
                out["last"].append(last)
                out["ids"].append(ids[i + 1 : j + 1].tobytes())
            return out

        return run

    texts = map_batches(docs.select("text"), "hash bigint, chunk string", prepare)
    entries = map_batches(
        texts.dropDuplicates(["hash"]), "hash bigint, first int, last int, ids binary", encoder
    )
    return {r["hash"]: (r["first"], r["last"], bytes(r["ids"])) for r in entries.collect()}


def encode_with(c: Codec, dictionary: dict[int, tuple], text: str) -> tuple[np.ndarray, bytes, int]:
    """Ids, decoded bytes and the number of reused chunks of one text."""
    if (c.special is not None and c.special.search(text)) or not dictionary:
        ids = c.encode(text)
        return ids, c.decode_bytes(ids), 0
    data = text.encode()
    borders = cuts(data)
    ids, decoded, done, reused = [], [], 0, 0
    for a, b in zip(borders, borders[1:]):
        entry = dictionary.get(chunk_hash(data[a:b])) if SHORTEST <= b - a <= LONGEST else None
        if entry is None:
            continue
        first, last, kept = entry
        join = c.plain(data[done : a + first].decode())
        known = np.frombuffer(kept, "<u4")
        ids += [join, known]
        decoded += [c.decode_bytes(join), c.decode_bytes(known)]
        done, reused = a + last, reused + 1
    rest = c.plain(data[done:].decode())
    ids.append(rest)
    decoded.append(c.decode_bytes(rest))
    return np.concatenate(ids), b"".join(decoded), reused


def encode_documents(
    docs: DataFrame, path: str, most: int = DICTIONARY_CHUNKS, with_ids: bool = False
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, n_reused`` of every whole text.

    ``with_ids`` adds the other columns of ``docs`` but ``text``, and ``input_ids``; a column
    of ``docs`` that is called like one of the new ones gives way to it.
    """
    dictionary = docs.sparkSession.sparkContext.broadcast(chunk_dictionary(docs, path, most))
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if with_ids else []
    own = ["n_tokens", "ids_sha256", "decoded_sha256", "n_reused", *["input_ids"] * with_ids]
    others = [c for c in others if c not in own]
    given = docs.select("doc_id", *others, "text")
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    schema = ", ".join(
        [f"`{c}` {kinds[c]}" for c in ["doc_id", *others]]
        + ["n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_reused bigint"]
        + ["input_ids array<int>"] * with_ids
    )

    def prepare():
        c = codec(path)
        known = dictionary.value

        def run(columns):
            out = {k: columns[k] for k in ["doc_id", *others]} | {k: [] for k in own}
            for text in columns["text"]:
                ids, decoded, reused = encode_with(c, known, text or "")
                shown = decoded.decode("utf-8", "replace").encode()
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(shown).hexdigest())
                out["n_reused"].append(reused)
                if with_ids:
                    out["input_ids"].append(ids.astype(np.int32))
            return out

        return run

    return map_batches(given, schema, prepare)
