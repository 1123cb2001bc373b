"""Token counts of whole texts with a public tokenizer file.

Texts longer than one chunk are encoded in overlapping chunks with offsets. Two neighbours are spliced at a boundary
that both encodings have, that is proven stable, and after which both agree to the overlap's end. If
no such boundary lies in the overlap it is doubled, at most to the text's end. Other texts are cut at
the same stable boundaries, and each distinct piece is encoded once for each task.

Stable is the end of a word before ASCII white space, if the word's last character cannot be white
space itself: a byte-level pre-tokenizer has no token with a non-space before a space. A tokenizer of
any other make (see ``_cuttable``) has no proof, so its texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_right
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
# Pieces remembered by a worker before it starts anew (about 40 MB).
CACHE_PIECES = 300_000
TOKEN_LIMIT = 512

# Other characters that a tokenizer may take as white space: no boundary right after them.
_RARE_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿]")
_SPACES = frozenset(" \t\n\r\x0b\x0c")
_S, _R = r" \t\n\r\x0b\x0c", _RARE_SPACE.pattern[1:-1]
_PIECE = re.compile(f"[{_S}]*+(?:[^{_S}{_R}]++|[{_R}][{_S}{_R}]*+)++|[{_S}]++")


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _cuttable(path: str) -> bool:
    """Whether the file is plain byte-level BPE: no normalizer, the usual split, no prefix space, no added token with or beside white space."""
    said = json.loads(_tokenizer(path).to_str())
    split, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
    plain = said.get("normalizer") is None and model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    alone = all(not (t.get("lstrip") or t.get("rstrip") or any(c.isspace() for c in t["content"])) for t in said.get("added_tokens") or [])
    return bool(plain and alone)


def _ends(tokenizer, text: str) -> list[int]:
    return [e for _, e in tokenizer.encode(text, add_special_tokens=False).offsets]


def _stable(text: str, at: int) -> bool:
    return text[at] in _SPACES and text[at - 1] not in _SPACES and not _RARE_SPACE.match(text[at - 1])


def splice(text: str, left: list[int], right: list[int], lo: int, hi: int) -> int | None:
    """The first stable boundary in (lo, hi) from which both lists of token ends agree up to hi's last stable one."""
    one, two = ([e for e in ends if lo < e < hi] for ends in (left, right))
    both = set(one) & set(two)
    last = next((p for p in range(hi - 1, lo, -1) if p in both and _stable(text, p)), None)
    if last is None:
        return None
    found, i, j = last, bisect_right(one, last) - 1, bisect_right(two, last) - 1
    while i >= 0 and j >= 0 and one[i] == two[j]:  # back as far as both agree, token by token
        if _stable(text, one[i]):
            found = one[i]
        i, j = i - 1, j - 1
    return found


def count_huge(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text`` from overlapping chunks; equal to encoding it whole."""
    total, start, settled, end = 0, 0, 0, min(len(text), chunk)
    ends = _ends(tokenizer, text[:end])
    while end < len(text):
        wide = overlap
        while True:
            begin = max(settled, end - wide)
            if begin <= settled:  # nothing stable between: encode both chunks as one
                start, end = settled, min(len(text), end + max(chunk, end - settled))
                ends = [start + e for e in _ends(tokenizer, text[start:end])]
                break
            to = min(len(text), begin + max(chunk, 2 * wide))
            following = [begin + e for e in _ends(tokenizer, text[begin:to])]
            if (p := splice(text, ends, following, begin, end)) is not None:
                total += sum(settled < e <= p for e in ends)
                settled, start, end, ends = p, begin, to, following
                break
            wide *= 2
    return total + sum(e > settled for e in ends)


def count_tokens(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text).

    ``path`` is a tokenizers JSON file that all workers see. Null text: empty, no tokens. Null ids
    and repeated rows pass through, other columns are ignored, no rows give no rows.
    """

    def count(batches):
        tokenizer, known, may_cut = _tokenizer(path), {}, _cuttable(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                whole, cut = {}, {}
                for i, text in enumerate(texts):
                    if not may_cut:
                        whole[i] = len(tokenizer.encode(text, add_special_tokens=False).ids)
                    elif len(text) > chunk:
                        whole[i] = count_huge(tokenizer, text, chunk, overlap)
                    else:
                        cut[i] = _PIECE.findall(text)
                if len(known) > CACHE_PIECES:
                    known.clear()
                new = list({p for pieces in cut.values() for p in pieces if p not in known})
                for piece, found in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                    known[piece] = len(found)
                n = [whole[i] if i in whole else sum(map(known.__getitem__, cut[i])) for i in range(len(texts))]
                size = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
