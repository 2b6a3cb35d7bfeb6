"""Token ids of whole texts as raw binary payloads.

Pieces of a text that the tokenizer treats alone are encoded once per worker and looked up afterwards, each once for all
texts of a step; the ids are those of encoding the whole text, because pieces are cut only where the byte-level splitter
always cuts.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .shared import text_bytes, worker_state

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
#: Pieces that a worker remembers at least; when it holds twice as many it forgets the older half (ids do not change).
REMEMBERED = 300_000
#: Longer pieces (texts without white space, or with special tokens) are not remembered.
LONGEST = 256
#: Text bytes that are encoded together.
ENCODE_BYTES = 4 << 20
LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"

# Kinds of bytes, and the pairs of neighbours between which a cut is always safe: before white space that follows none,
# after a line end between others, and before . or , after a letter.
OTHER, SPACE, LINE, ASCII_LETTER, STOP, HIGH = range(6)
KIND = np.full(256, OTHER, np.uint8)
KIND[32], KIND[9:14], KIND[128:] = SPACE, LINE, HIGH
KIND[65:91] = KIND[97:123] = ASCII_LETTER
KIND[[44, 46]] = STOP
CUT = np.zeros((8, 8), bool)
CUT[[[OTHER], [ASCII_LETTER], [STOP]], [SPACE, LINE]] = True
CUT[ASCII_LETTER, STOP] = True
# After a byte beyond ASCII it depends on the character.
ASK = np.zeros((8, 8), bool)
ASK[HIGH, [SPACE, LINE, STOP]] = True
AFTER_LINE = np.zeros((8, 8), bool)
AFTER_LINE[LINE, [OTHER, ASCII_LETTER, STOP]] = True


def piece_starts(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts that stand one after another; texts marked in ``whole`` are one piece each."""
    kind = KIND[data]
    pair = (kind[:-1] << np.uint8(3)) | kind[1:]
    cut = np.zeros(len(data) + 1, bool)
    cut[1 : len(data)] = CUT.reshape(-1)[pair]
    at = np.flatnonzero(ASK.reshape(-1)[pair]) + 1
    if len(at):
        last, second, third = data[at - 1], data[at - 2], data[at - 3]
        # Spaces beyond ASCII are U+0085 and U+00A0, and some of those that begin with bytes E1 to E3.
        blank = (second == 0xC2) & ((last == 0x85) | (last == 0xA0)) | (third >= 0xE1) & (third <= 0xE3)
        letter = (second == 0xC3) & (last != 0x97) & (last != 0xB7)
        cut[at] = np.where(kind[at] == STOP, letter, ~blank)
    cut[offsets[:-1]] = True  # an empty text shares the place of the next one, or the end
    # Longer white space is cut before its last character by the splitter only if something follows.
    at = np.flatnonzero(AFTER_LINE.reshape(-1)[pair]) + 1
    cut[at] |= cut[at - 1]
    for i in np.flatnonzero(whole).tolist():
        cut[offsets[i] + 1 : offsets[i + 1]] = False
    return np.flatnonzero(cut[: len(data)])


# Pieces that the splitter cuts into runs of letters, of digits, and of signs other than apostrophes; a space goes with the
# first run.
RUN = re.compile(rf" ?(?:[{LETTER}]+|[0-9]+|[!-&(-/:-@\[-`{{-~]+)")
RUNS = re.compile(rf" ?[{LETTER}0-9!-&(-~]+")


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes are their own, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces(dict):
    """Ids of pieces; those of a piece that is asked for first are found by ``learn``."""

    def __init__(self, learn: Callable[[str], bytes]) -> None:
        self.learn = learn

    def __missing__(self, piece: str) -> bytes:
        ids = self.learn(piece)
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids


class Encoder:
    """Encodes texts to ids as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    The string of a special token in a text is that token, unless ``special_as_text``. Pieces that were met lately are looked
    up; of others, runs of one kind of character go straight to the merges.
    """

    def __init__(self, vocabulary: str = VOCABULARY, special_as_text: bool = False) -> None:
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = special_as_text
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.merge = self.tokenizer.model.tokenize
        self.known, self.older = Pieces(self._learn), {}
        self.letters = byte_letters()
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added if not special_as_text or not t.special]
        self.names = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    @classmethod
    def of_worker(cls, vocabulary: str = VOCABULARY) -> Encoder:
        return worker_state(f"encoder {vocabulary}", lambda: cls(vocabulary))

    def _learn(self, piece: str) -> bytes:
        """Ids of a piece that is not known, from the older half of the memory or from the tokenizer."""
        ids = self.older.get(piece)
        if ids is not None:
            return ids
        if self.names and self.names.search(piece):
            return self._whole(piece)
        if RUN.fullmatch(piece):
            # In ASCII only the space is spelled by another letter.
            spelled = piece.replace(" ", self.letters[32]) if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            return self._bytes([t.id for t in self.merge(spelled)])
        if RUNS.fullmatch(piece):
            return b"".join(map(self.known.__getitem__, RUN.findall(piece)))
        return self._whole(piece)

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.dtype.char, ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with the end id, as little-endian numbers of ``dtype``."""
        return self.encode_column(pa.array(texts, pa.string())).to_pylist()

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """``encode`` for a column without nulls: the different pieces of all texts are looked up, then dealt out."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, Pieces(self._learn)
        data, offsets = text_bytes(texts)
        whole = np.zeros(len(texts), bool)
        for name in self.special:
            whole |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        starts = piece_starts(data, offsets, whole)
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        found = list(map(self.known.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False).tolist()))
        ends = np.searchsorted(starts, offsets[1:])  # pieces up to the end of each text
        order = np.insert(np.asarray(pieces.indices), ends, len(found))
        joined = pa.array([*found, self._bytes([END_ID])], pa.binary()).take(pa.array(order))
        _, at, ids = joined.buffers()
        bound = np.frombuffer(at, np.int32)[np.append(0, ends + np.arange(1, len(texts) + 1))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bound), ids])
