"""Byte-level BPE on sentencepiece's merge engine, with a model serialised straight from a rank file."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ._common import id_text, in_calls, read

#: Entries that a task's table of known pre-tokens may hold, and the longest pre-token it keeps.
CACHE, CACHED_CHARS = 400_000, 48


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_letters() -> list[str]:
    """A visible letter for each byte: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in own else chr(0x100 + rest.index(b)) for b in range(256)]


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece BPE model of a rank table.

    Piece i is the byte-mapped token of rank i and scores -i, so that the best-scored merge is the merge of lowest
    rank. An unknown piece closes the list; it is never met, as all 256 bytes are pieces. The normaliser is the identity:
    no prefix space, no removal or escaping of white space. Ranks must run from 0 without gaps.
    """
    letters, tokens = byte_letters(), sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a token: {missing}")
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + _varint(kind))
    pieces = b"".join(piece("".join(letters[b] for b in t), -float(i), 1) for i, t in enumerate(tokens))
    trainer = b"\x18\x02" + b"\xc0\x02" + _varint(len(tokens))  # model_type BPE; unk_id
    normalizer = _field(1, b"identity") + b"\x18\x00\x20\x00\x28\x00"
    return pieces + piece("<unk>", 0.0, 2) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one rank table. Encoding gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.engine = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.letters = dict(enumerate(byte_letters()))
        self.whole = {token.decode(): i for token, i in ranks.items() if _is_text(token)}
        self.token = sorted(ranks, key=ranks.get)
        self.known: dict[str, bytes] = {}

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Each pre-token's ids. A pre-token that is itself a token is that token; the others are merged."""
        found = [struct.pack("<I", self.whole[p]) if p in self.whole else None for p in pieces]
        rest = [p.encode().decode("latin-1").translate(self.letters) for p, f in zip(pieces, found) if f is None]
        merged = iter(self.engine.encode(rest, num_threads=1) if rest else ())
        return [f if f is not None else np.asarray(next(merged), "<u4").tobytes() for f in found]

    def encode(self, text: str) -> bytes:
        pieces = self.split(text)
        known = self.known
        if new := [p for p in set(pieces) if p not in known]:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = list(set(pieces))
            known.update(zip(new, self.encode_pieces(new)))
        out = b"".join(map(known.__getitem__, pieces))
        for p in new if new else ():
            if len(p) > CACHED_CHARS:
                del known[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", outputs: str = "digest") -> DataFrame:
    """Encodes every whole text by the rank file's merges and decodes the ids again.

    The text is split by the pattern and each match encoded separately, as plain text (no special tokens). The rank
    file is public, of fixed size, and read where the tasks run; each task keeps a bounded table of pre-tokens it has
    met. outputs: "digest" gives doc_id, n_tokens, ids_sha256, decoded_sha256; "ids" gives doc_id, ids (array of int),
    decoded (string). No shuffle takes place.

    Null and empty texts have no tokens; ids may be null or repeated, each row gets its result; an empty table gives an
    empty result; other columns are ignored. Texts of any length are encoded whole.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = ByteBpe(load_ranks(ranks_path), pattern)
        for part in (p for batch in batches for p in in_calls(batch)):
            ids = [bpe.encode(t) for t in part["text"]]
            texts = [bpe.decode(i) for i in ids]
            if outputs == "ids":
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [np.frombuffer(i, "<u4").astype(np.int32) for i in ids], "decoded": [t.decode() for t in texts]})
            else:
                digest = lambda xs: [hashlib.sha256(x).hexdigest() for x in xs]
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": [len(i) // 4 for i in ids], "ids_sha256": digest(ids), "decoded_sha256": digest(texts)})

    schema = "doc_id long, ids array<int>, decoded string" if outputs == "ids" else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return id_text(docs, id_col, text_col).mapInPandas(run, schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


SQL: dict[str, str] = {}
QUERIES = {"op10_byte_bpe": op10_byte_bpe}
