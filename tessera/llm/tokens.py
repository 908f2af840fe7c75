"""Token ids of whole texts by a public tokenizer file that is given as a path.

The vocabulary is lower case, drops white space and never joins across it, nor across the places where letters, digits
and symbols meet. So texts are cut into runs at ASCII white space, each distinct run of some megabytes of text is looked
up once, and a text's ids are the runs' ids one after the other. A run of plain characters is put together from its
letters, digits and symbols, and these are remembered; what is remembered is bounded in number and length.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = b" \t\n\r\x0b\x0c"
CLOSING = b".,!?;:"
#: Lower-case letters of the Latin-1 supplement that are composed already, or have no accent, and stay what they are.
LATIN = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_PLAIN = re.compile(f"[!-~{LATIN}]+").fullmatch
#: What the tokenizer's own expression finds in plain lower-case runs.
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^0-9a-z{LATIN}]+").findall
PART = 1 << 22
_loaded: dict[str, RunTokens] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _ends_in_letter(core: bytes) -> bool:
    """An ASCII letter or digit, or a letter of the Latin-1 supplement."""
    last = core[-1]
    return last < 128 and core[-1:].isalnum() or core[-2:-1] == b"\xc3" and last not in (0x97, 0xB7)


class RunTokens:
    """The ids of runs as little-endian unsigned 32-bit integers, one after the other.

    What it remembers are flat arrays, some 50 bytes a run: ``most`` runs of at most ``longest`` bytes. When there are
    more, it keeps the half that was asked for last. ``pieces`` has the letters, digits and symbols of mixed runs.
    """

    def __init__(self, path: str, most: int = 1_000_000, longest: int = 64) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.most, self.longest = Tokenizer.from_file(path), most, longest
        # Plain letters, digits or symbols need no normalising and no cutting: the model alone encodes them.
        self.model = self.tokenizer.model
        spelled = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {ord(c): spelled.pre_tokenize_str(c)[0][0] for c in LATIN}
        self.pieces: dict[str, bytes] = {}
        self.runs, self.ids = pa.array([], pa.string()), np.array([], "<u4")
        self.size, self.used, self.now = np.array([], np.int32), np.array([], np.int32), 0

    def _run(self, run: bytes) -> bytes:
        if len(run) <= self.longest:
            text = run.decode("utf-8", "replace").lower()
            if run.isalpha():
                return self._plain(text)
            if _PLAIN(text) and "<|" not in text:
                return b"".join(map(self._piece, _PIECES(text)))
        core = run.rstrip(CLOSING)
        if core and len(core) < len(run) and _ends_in_letter(core):
            return self._run(core) + self._run(run[len(core) :])
        return array("I", self.tokenizer.encode(run.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def _piece(self, text: str) -> bytes:
        out = self.pieces.get(text)
        if out is None:
            if len(self.pieces) >= self.most // 10:
                self.pieces.clear()
            out = self.pieces[text] = self._plain(text)
        return out

    def _plain(self, text: str) -> bytes:
        spelled = text if text.isascii() else text.translate(self.spelling)
        return array("I", [x.id for x in self.model.tokenize(spelled)]).tobytes()

    def _find(self, runs: pa.StringArray) -> np.ndarray:
        """The places of distinct runs in what is remembered, where new ones are put last."""
        at = pc.fill_null(pc.index_in(runs, value_set=self.runs), -1).to_numpy().copy()
        new = np.flatnonzero(at < 0)
        at[new] = np.arange(len(self.runs), len(self.runs) + len(new))
        added = runs.take(pa.array(new))
        made = list(map(self._run, _bytes(added)))
        self.runs = pa.concat_arrays([self.runs, added])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), "<u4")])
        self.size = np.concatenate([self.size, np.fromiter(map(len, made), np.int32, len(made)) // 4])
        self.used = np.concatenate([self.used, np.zeros(len(made), np.int32)])
        self.now += 1
        self.used[at] = self.now
        return at

    def _forget(self) -> None:
        """Bring what is remembered back within its bounds."""
        kept = np.flatnonzero(pc.binary_length(self.runs).to_numpy() <= self.longest)
        if len(kept) > self.most:
            kept = np.sort(kept[np.argsort(-self.used[kept], kind="stable")[: self.most // 2]])
        if len(kept) < len(self.runs):
            self.ids = self.ids[_places(self.size, kept)]
            self.runs, self.size, self.used = self.runs.take(pa.array(kept)), self.size[kept], self.used[kept]

    def encode(self, text: bytes) -> bytes:
        """All ids of a text, as bytes."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; what is longer than a part goes by parts that end at white space."""
        found = iter(self._together([t for t in texts if len(t) <= PART]))
        return [
            next(found) if len(t) <= PART else b"".join(self._together([x])[0] for x in _parts(t, PART)) for t in texts
        ]

    def _together(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, by the distinct runs of all."""
        # Special tokens are told apart by case, so a text that may hold one is left as it is.
        held = pa.array([t if b"<|" in t else t.lower() for t in texts], pa.binary())
        cut = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(held), *held.buffers()[1:]))
        runs = cut.values.dictionary_encode()
        of = self._find(runs.dictionary)[runs.indices.to_numpy()]
        ids = memoryview(self.ids[_places(self.size, of)].tobytes())
        bounds = (np.append(0, self.size[of].cumsum(dtype=np.int64))[cut.offsets.to_numpy()] * 4).tolist()
        self._forget()
        pa.default_memory_pool().release_unused()  # else a worker holds on to what its largest part took
        return [bytes(ids[a:b]) for a, b in zip(bounds, bounds[1:])]


def _bytes(runs: pa.StringArray) -> list[bytes]:
    _, at, held = runs.buffers()
    bounds = np.frombuffer(at, "<i4", len(runs) + 1).tolist() if len(runs) else []
    held = held.to_pybytes() if held else b""
    return [held[a:b] for a, b in zip(bounds, bounds[1:])]


def _places(size: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Where the items of the given groups stand, when groups of these sizes lie one after the other."""
    each = size[of]
    ends = each.cumsum(dtype=np.int64)
    at = np.repeat((size.cumsum(dtype=np.int64) - size)[of] - (ends - each), each)
    at += np.arange(len(at))
    return at


def _parts(text: bytes, size: int):
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and text[end] not in SPACE:
            end += 1
        yield text[at:end]
        at = end


def load(path: str) -> RunTokens:
    """One for each path and worker process."""
    if path not in _loaded:
        _loaded[path] = RunTokens(path)
    return _loaded[path]
