"""SentencePiece models on the tokenizers library: parse the protobuf, rebuild the parts, encode and decode whole columns.

The model file is parsed here (wire format); its normaliser (character map, dummy prefix, space handling), the metaspace
mark, piece scores (unigram models: the scores themselves; BPE models: merges in the order of the scores) and byte fallback
are rebuilt. No piece holds a mark after another character (checked), so texts are cut before marks. Each task encodes
a distinct part once, in multithreaded batches of joined parts; documents gather the ids of their parts as arrays.

Every part's ids are decoded again by the library and held against those of the sentencepiece library: `round_trip` and `parity` are
false for a document with a part that differs. Parts meet at marks only, so a document decodes to its parts' texts one after another.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import byte_slices, worker_state

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
COLUMNS = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, round_trip boolean, parity boolean"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class Spec:
    """What a model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback = UNIGRAM, False
        self.charsmap, self.dummy_prefix, self.squeeze = b"", True, True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                self.kind, self.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            elif number == 3:
                own = dict(_fields(value))
                self.charsmap, self.dummy_prefix, self.squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        usual = [p for p, _, kind in self.pieces if kind in (NORMAL, USER)]
        self.cuttable = not any(re.search(f"[^{MARK}]{MARK}", p) for p in usual)


class Codec:
    """Encoder and decoder of one model in one process; keeps the ids of at most `most` parts, the frequent ones longest."""

    def __init__(self, model: bytes, threads: int = 2, most: int = 300_000, verify: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from tokenizers import Tokenizer, decoders, models, normalizers

        self.spec = spec = Spec(model)
        vocab = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
        if spec.kind == BPE:
            score = {p: s for p, s, kind in spec.pieces if kind in (NORMAL, USER)}
            pairs = [(-s, vocab[p], p[:i], p[i:]) for p, s in score.items() for i in range(1, len(p)) if p[:i] in score and p[i:] in score]
            core = models.BPE(vocab, [(a, b) for _, _, a, b in sorted(pairs)], unk_token=spec.pieces[spec.unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
        else:
            # control pieces never match text; a text with the very name of a byte piece is flagged by `parity`
            core = models.Unigram([("\0" + p if kind in (CONTROL, UNUSED) else p, s) for p, s, kind in spec.pieces], spec.unknown, spec.byte_fallback)
        self.tokenizer = Tokenizer(core)
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.charsmap = normalizers.Precompiled(spec.charsmap) if spec.charsmap else None
        #: With a dummy prefix a part is a mark and what follows; else marks and what follows, or the whole text.
        self.prefixed = spec.cuttable and spec.dummy_prefix
        self.cut = re.compile(f"{MARK}({MARK}*[^{MARK}]*)" if self.prefixed else f"{MARK}*[^{MARK}]+|{MARK}+" if spec.cuttable else "(?s).+")
        self.begins = np.array([p.startswith(MARK) and kind in (NORMAL, USER) for p, _, kind in spec.pieces])
        self.most = most
        self._forget()
        self.reference = None
        if verify:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_proto=model)

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.start, self.size, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.same, self.back = np.zeros(0, bool), np.zeros(0, bool)
        self.flat = np.zeros(0, np.int32)

    def _trim(self) -> None:
        """Forget the rarer half of the parts."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.most // 2])
        names = list(self.number)
        self.number = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.flat = self.flat[_ranges(self.start[keep], self.size[keep])]
        self.size, self.used, self.same, self.back = self.size[keep], self.used[keep] // 2, self.same[keep], self.back[keep]
        self.start = np.cumsum(self.size) - self.size

    def spaced(self, text: str | None) -> str:
        """The text as the model sees it, without the dummy prefix."""
        text = (text or "").replace(MARK, " ")
        if self.charsmap:
            text = self.charsmap.normalize_str(text).replace(MARK, " ")
        return re.sub(" +", " ", text.strip(" ")) if self.spec.squeeze else text

    def normal(self, text: str | None) -> str:
        """The text as the model sees it, spaces as marks."""
        text = self.spaced(text)
        return (" " + text if text and self.spec.dummy_prefix else text).replace(" ", MARK)

    def _ids(self, lines: list[str]) -> tuple[list[list[int]], list[bool], list[bool]]:
        """Ids of each line, whether sentencepiece gives the same, and whether they decode to the line."""
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        plain = [x.replace(MARK, " ") for x in lines]
        back = [a == b for a, b in zip(self.tokenizer.decode_batch(ids, skip_special_tokens=False), plain, strict=True)]
        if not self.reference:
            return ids, [True] * len(lines), back
        said = self.reference.encode([x[1:] for x in plain] if self.spec.dummy_prefix else plain, num_threads=1)
        if self.spec.dummy_prefix and MARK in lines:  # a mark alone ends a text: no dummy prefix stands for it
            before, both = self.reference.encode(["x", "x "], num_threads=1)
            said[lines.index(MARK)] = both[len(before) :]
        return ids, [a == b for a, b in zip(ids, said, strict=True)], back

    def _learn(self, keys: list[str], group: int = 64, most: int = 20_000) -> None:
        """Ids of new parts: many in one line each, which is cut at the pieces that begin with a mark; what differs goes again alone."""
        joined = [k for k in keys if k and MARK not in k] if self.prefixed else []
        alone = [k for k in keys if not k or MARK in k] if self.prefixed else keys
        groups = [joined[i : i + group] for i in range(0, len(joined), group)]
        for i in range(0, len(groups), most // group):
            now = groups[i : i + most // group]
            ids, same, back = self._ids([MARK + MARK.join(g) for g in now])
            flat = np.fromiter(chain.from_iterable(ids), np.int32)
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            first = np.cumsum(length) - length
            begins = self.begins[flat]
            good = np.array(same) & np.array(back) & begins[first] & (np.add.reduceat(begins, first, dtype=np.int64) == np.fromiter(map(len, now), np.int64, len(now)))
            for k in np.flatnonzero(~good).tolist():
                alone = alone + now[k]
            flat, begins = (x[np.repeat(good, length)] for x in (flat, begins))
            self._add([p for g, ok in zip(now, good.tolist(), strict=True) if ok for p in g], flat, np.diff(np.flatnonzero(begins), append=len(flat)))
        for i in range(0, len(alone), most):
            now = alone[i : i + most]
            ids, same, back = self._ids([MARK + k for k in now] if self.prefixed else now)
            self._add(now, np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids)), same, back)

    def _add(self, names: list[str], flat: np.ndarray, size: np.ndarray, same: list[bool] | None = None, back: list[bool] | None = None) -> None:
        n = len(names)
        self.number.update(zip(names, range(len(self.size), len(self.size) + n), strict=True))
        self.start = np.r_[self.start, len(self.flat) + np.cumsum(size) - size]
        self.size, self.used, self.flat = np.r_[self.size, size], np.r_[self.used, np.zeros(n, np.int64)], np.r_[self.flat, flat]
        self.same, self.back = (np.r_[x, np.ones(n, bool) if y is None else np.array(y, bool)] for x, y in ((self.same, same), (self.back, back)))

    def _parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Parts of all texts one after another, and the text of each."""
        if self.charsmap or self.spec.squeeze:
            texts = pa.array([self.spaced(t) for t in texts.to_pylist()], pa.large_string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        loose = pc.or_(pc.match_substring_regex(texts, "^ | $|  "), pc.match_substring(texts, MARK))
        slow = np.flatnonzero(loose.to_numpy(zero_copy_only=False)) if self.prefixed else np.arange(len(texts))
        fast = np.setdiff1d(np.flatnonzero(pc.binary_length(texts).to_numpy(zero_copy_only=False)), slow) if self.prefixed else slow[:0]
        lists = pc.split_pattern(texts.take(pa.array(fast)), " ")
        parts, of = [lists.flatten()], [np.repeat(fast, pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
        if len(slow):
            own = [self.cut.findall(self.normal(t)) for t in texts.take(pa.array(slow)).to_pylist()]
            parts.append(pa.array([p for x in own for p in x], pa.large_string()))
            of.append(np.repeat(slow, [len(x) for x in own]))
        return pa.concat_arrays(parts), np.concatenate(of)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts one after another, their number in each, whether they are those of sentencepiece, and whether they decode to the text."""
        parts, of = self._parts(texts)
        held = parts.dictionary_encode()
        names, index = held.dictionary.to_pylist(), held.indices.to_numpy()
        new = [p for p in names if p not in self.number]
        if len(self.number) + len(new) > self.most:
            self._trim()
            new = [p for p in names if p not in self.number]
        self._learn(new)
        known = np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))
        self.used[known] += np.bincount(index, minlength=len(names))
        if not (of[1:] >= of[:-1]).all():
            index, of = index[order := np.argsort(of, kind="stable")], of[order]
        number = known[index]
        size = self.size[number]
        n = np.bincount(of, weights=size, minlength=len(texts)).astype(np.int64)
        flags = (np.bincount(of[~x[number]], minlength=len(texts)) == 0 for x in (self.same, self.back))
        return self.flat[_ranges(self.start[number], size)], n, *flags

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of ids; the dummy prefix goes."""
        texts = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [t.removeprefix(" ") for t in texts] if self.spec.dummy_prefix else texts


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers of all ranges, one range after another."""
    end = np.cumsum(size)
    return np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)


def _codec(model: bytes, threads: int, verify: bool) -> Codec:
    """The codec of this Python worker: tasks that follow one another share what it has learnt."""
    return worker_state(("codec", model, threads, verify), lambda: Codec(model, threads, verify=verify))


def encoded(docs: DataFrame, model_path: str = DEFAULT_MODEL, threads: int = 2, verify: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, ids, ids_sha256 (of little-endian int32), round_trip, parity.

    round_trip: the decoded ids are the normalised text. parity: the ids are those of the sentencepiece library. Null and
    empty texts have no ids. The model file is read by the driver and broadcast (its size is the vocabulary's, not
    the data's). Repeated rows give equal rows; an empty table gives none; other columns are not read.
    """
    with open(model_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value, threads, verify)
        for part in byte_slices(batches, "text", 4 << 20):
            flat, n, same, back = codec.encode(part.column("text"))
            ends = np.r_[0, np.cumsum(n)]
            data = memoryview(flat.astype("<i4", copy=False)).cast("B")
            digests = [hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.record_batch([part.column("doc_id"), pa.array(n), column, pa.array(digests, pa.string()), pa.array(back), pa.array(same)], names=[c.split()[0] for c in COLUMNS.split(", ")])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, COLUMNS)


def decoded(tokens: DataFrame, model_path: str = DEFAULT_MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of an ids column, a row for each row of tokens.

    Null ids give a null text, no ids an empty one. Repeated rows give equal rows; an empty table gives none; other columns are not read.
    """
    with open(model_path, "rb") as f:
        sent = tokens.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_state(("decoder", sent.value), lambda: Codec(sent.value, verify=False))
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            texts = codec.decode([x or [] for x in ids])
            yield pa.record_batch([batch.column("doc_id"), pa.array([None if x is None else t for x, t in zip(ids, texts, strict=True)], pa.string())], names=["doc_id", "text"])

    return tokens.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{ids_col}` as ids").mapInArrow(run, "doc_id long, text string")
