"""Token ids of many texts at once, equal to those of the tokenizer file."""

from __future__ import annotations

import base64
import functools
import json
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

#: a space beside more white space: such texts are not cut at spaces
UNEVEN = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] | [\s\x0b\x1c-\x1f\x{85}\p{Z}]"
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]$"


def _joined(strings: pa.StringArray) -> str:
    """All strings one after another, as they already lie in their buffer."""
    if not len(strings):
        return ""
    edges = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    return strings.buffers()[2].slice(int(edges[0]), int(edges[-1] - edges[0])).to_pybytes().decode()


class Encoder:
    """Byte-level BPE over batches of texts.

    A single space always starts a new word for the tokenizer, so a text is cut there and each distinct
    piece of a batch is encoded once. The pieces are encoded as one string, by the library that reads the
    vocabulary as ranks, and cut again by the lengths of the tokens. Texts with a space beside more white
    space, with a zero byte or with a special token go to the tokenizer itself.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str):
        self.path = tokenizer_path
        with open(tokenizer_path, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file)["added_tokens"]]
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        # a special token that no piece holds: the search for none at all would look at every place
        self.fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"\x00": max(ranks.values()) + 1})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)

    @functools.cached_property
    def tokenizer(self) -> Tokenizer:
        """Read when a text needs it: it takes up much memory."""
        return Tokenizer.from_file(self.path)

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the distinct pieces one after another, and where each begins (and the last ends)."""
        joined = pc.and_(pc.starts_with(pieces, " "), pc.invert(pc.match_substring_regex(pieces, SPACE)))
        ids = self.fast.encode_to_numpy(_joined(pieces.filter(joined)), disallowed_special=())
        joined = joined.to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        reached = np.cumsum(self.width[ids])
        ends = np.searchsorted(reached, np.cumsum(sizes[joined])) + 1
        if len(ends) and not (reached[ends - 1] == np.cumsum(sizes[joined])).all():
            raise ValueError("a token spans two words")
        counts = np.zeros(len(pieces), np.int64)
        counts[joined] = np.diff(ends, prepend=0)
        alone = [np.array(self.fast.encode_ordinary(p), np.uint32) for p in pieces.filter(pa.array(~joined)).to_pylist()]
        counts[~joined] = [len(a) for a in alone]
        starts = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(starts[-1], np.uint32)
        at = np.repeat(joined, counts)
        out[at] = ids
        out[~at] = np.concatenate(alone) if alone else []
        return out, starts

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text, without special tokens added; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = pc.invert(pc.match_substring_regex(texts, UNEVEN))
        for stop in ["\x00", *self.special]:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, stop)))
        plain = plain.to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        for i in np.flatnonzero(~plain).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        chosen = texts.filter(pa.array(plain))
        if not len(chosen):
            return out
        lists = pc.split_pattern(pc.replace_substring(chosen, " ", "\x00 "), "\x00")
        coded = lists.flatten().dictionary_encode()
        ids, starts = self._distinct(coded.dictionary.cast(pa.string()))
        code = coded.indices.to_numpy()
        counts = (starts[1:] - starts[:-1])[code]
        ends = np.cumsum(counts)
        # position in ``ids`` of every token: the start of its piece and on
        where = np.repeat(starts[code] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        flat = ids[where]
        cuts = np.concatenate([[0], ends])[lists.offsets.to_numpy()]
        for i, low, high in zip(np.flatnonzero(plain).tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
            out[i] = flat[low:high]
        return out


def encoder_of_process(*files: str) -> Encoder:
    """The encoder of this process: one for all tasks that a Python worker runs.

    It hangs on the ``sys`` module, since a task brings its own copy of this one.
    """
    made = sys.__dict__.setdefault("_sheetwise_encoders", {})
    if files not in made:
        made[files] = Encoder(*files)
    return made[files]
