"""Removing byte strings that an earlier document holds too, by merging Burrows-Wheeler transforms.

1. Documents fall into pieces around anchors (``anchors``); equal 50-byte strings lie in pieces of one anchor. Pieces travel
   by anchor. A piece whose bytes are those of a piece of a smaller document is a repeat as a whole.
2. Pieces of one anchor that differ, and come from several documents, may still share strings. They are put in buckets by
   anchor. In a bucket, shards of pieces are sorted and transformed, and the transforms merged by interleave refinement
   (``bwt``). Neighbours with a common prefix of 50 bytes form an interval; in an interval, the strings of all but the
   smallest document are repeats.
3. An anchor with very many pieces goes through plain aggregations instead, first by whole pieces, then, for pieces that no
   smaller document holds whole, by runs of seven strings, and for runs that no smaller document holds, string by
   string. So no bucket grows with the number of documents that share a passage.
   Such anchors are found by counting the pieces of a sample of the rows first, so their pieces don't travel by anchor
   at all; smaller crowds show when the pieces of an anchor are compared.
4. Every document gets its repeats back and loses the bytes that they cover.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirworks.llm import bwt
from weirworks.llm.anchors import WINDOW, pieces, shared_parts
from weirworks.llm.common import LAST_ID, col, slices, text_or_empty
from weirworks.llm.hashing import BASE
from weirworks.session import cut_lineage, lean_steps

FLUSH_BYTES, CHUNK_BYTES, PART_BYTES = 8 << 20, 1 << 17, 6 << 20  # a chunk's arrays of eight bytes a place stay in a core's cache
BUCKET_PIECES, SHARD_PIECES, MANY = 6_000, 3_000, 2_048
SAMPLE, CROWDS = 32, 1_000_000  # one row in SAMPLE is counted; anchors that are sent apart at most
WIDTH = 22  # bytes of a packed piece
STEP = 5  # symbols by which a round of the merge refines the order; WINDOW is a multiple
MARKS = "doc_id long, text_id long, lo int, hi int"
# Of crowded anchors (bucket -1) the anchor and the hashes of the whole piece and of its sides too.
APART = ("anchor", "whole", "left", "right")
COMPARED = MARKS + ", bucket long" + "".join(f", {c} long" for c in APART)
RUN = 7  # strings of a crowded anchor that are first compared together; a piece has 35 at most
STRINGS = 20_000  # rows of strings made before they are handed on
ID_BUCKETS, SHARED_IDS = 1 << 16, 1_000  # of hashes of ids; those of ids with several rows that are told apart from the others


def _planes(values: np.ndarray, width: int) -> bytes:
    """The first bytes of all values, then the second ones and so on, so that those that hardly vary compress."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(data: bytes, rows: int, width: int, at: int = 0) -> np.ndarray:
    wide = np.zeros((rows, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, rows * width, at).reshape(width, rows).T
    return wide.view("<u8").ravel()


def _pack_ids(ids: np.ndarray) -> bytes:
    """Differences to the number before."""
    return _planes(np.diff(np.asarray(ids, np.int64), prepend=np.int64(0)), 8)


def _unpack_ids(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data, len(data) // 8, 8).view(np.int64))


def _pack(p: dict[str, np.ndarray]) -> bytes:
    """Of pieces in order of their documents, six bytes of anchor and whole each, two of each side, then how far the
    document is from that of the piece before (1), lo (4) and hi - lo (1)."""
    planes = [_planes(p[k], width) for k, width in (("anchor", 6), ("whole", 6), ("left", 2), ("right", 2))]
    planes += [_planes(np.diff(p["doc"], prepend=p["doc"].dtype.type(0)), 1), _planes(p["lo"], 4), _planes(p["hi"] - p["lo"], 1)]
    return b"".join(planes)


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    n, at, out = len(data) // WIDTH, 0, {}
    for k, width in (("anchor", 6), ("whole", 6), ("left", 2), ("right", 2), ("doc", 1), ("lo", 4), ("hi", 1)):
        out[k] = _numbers(data, n, width, at)
        at += n * width
    out |= {k: out[k].astype(np.uint16) for k in ("left", "right")} | {k: out[k].astype(np.int32) for k in ("lo", "hi")}
    return out | {"doc": np.cumsum(out["doc"].view(np.int64)), "hi": out["lo"] + out["hi"]}


def _halved(side: np.ndarray) -> np.ndarray:
    """The upper half of hashes of sides; 0 stays for those that are none."""
    half = side.dtype.itemsize * 4
    return np.maximum(side >> side.dtype.type(half), side > 0).astype(f"u{half // 8}")


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where, in sorted columns, a new combination begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _by_anchor(anchor: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The order of packed pieces by anchor, then whole: by 48 and 16 bits at once, and again where those 16 are not enough."""
    key = (anchor << np.uint64(16)) | (whole & np.uint64(0xFFFF))
    order = np.argsort(key)
    ordered, of_whole = key[order], whole[order]
    new = _groups(ordered)
    group = np.cumsum(new) - 1
    clash = np.zeros(len(order), bool)
    clash[group[~new & _groups(of_whole)]] = True
    again = np.flatnonzero(clash[group])
    part = order[again]
    order[again] = part[np.lexsort((whole[part], key[part]))]
    return order


def _by_doc(number: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(number, kind="stable")
    cuts = np.flatnonzero(_groups(number[order])) if len(order) else np.array([], np.int64)
    for part in np.split(order, cuts[1:]) if len(order) else []:
        yield int(number[part[0]]), [c[part] for c in columns]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in slices(batches):
        data = [t.encode("utf-8", "replace") for t in batch["text"]]
        anchor, n = np.unique(pieces(data)["anchor"], return_counts=True)
        yield pd.DataFrame({"anchor": anchor.view(np.int64), "n": n})


def crowded_anchors(rows: DataFrame) -> np.ndarray:
    """Anchors (sorted) that in a sample of the rows have more pieces than MANY would leave there.

    The sample decides only by which way an anchor's strings are compared. Twice as many pieces as MANY give twice the
    count that is asked for, so a larger crowd is missed less than once in a million. At most CROWDS anchors come
    back, those with the most pieces; any other has at most one in CROWDS of all pieces.
    """
    counts = rows.where(F.rand(11) * SAMPLE < 1).select("text").mapInPandas(_counted, "anchor long, n long")
    counts = counts.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > MANY // SAMPLE)
    found = counts.orderBy(F.desc("n"), "anchor").limit(CROWDS).select("anchor").toPandas()["anchor"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


SHIPPED = "part int, docs array<long>, texts array<long>, payload binary, lo array<int>, hi array<int>" + "".join(f", {c} array<long>" for c in APART)
SENT = SHIPPED.replace("docs array<long>, texts array<long>", "docs binary, texts binary")


def _shipped(parts: int, crowds: np.ndarray):
    """Pieces by the part of their anchor, but those of ``crowds`` by document.

    Copies among the texts at hand are marked here and don't travel.
    """

    def flush(held: list[dict[str, np.ndarray]], docs: list[int], texts: list[int]) -> Iterator[tuple]:
        p = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        ids, names = np.array(docs, np.int64), np.array(texts, np.int64)
        # Should two hashes clash here, a copy travels like any other piece.
        order = np.argsort(p["anchor"] ^ (p["whole"] * np.uint64(BASE)))
        new = _groups(p["anchor"][order], p["whole"][order])
        doc, copy = ids[p["doc"][order]], np.zeros(len(order), bool)
        copy[order] = doc > np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1] if len(new) else new
        crowd = np.isin(p["anchor"], crowds) & ~copy
        for doc, (lo, hi) in _by_doc(p["doc"][copy], p["lo"][copy], p["hi"][copy]):
            yield doc % parts, [docs[doc]], [texts[doc]], None, lo, hi, None, None, None, None
        for doc, (lo, hi, *hashes) in _by_doc(p["doc"][crowd], *(p[k][crowd] for k in ("lo", "hi", *APART))):
            yield doc % parts, [docs[doc]], [texts[doc]], None, lo, hi, *(h.astype(np.int64) for h in hashes)
        p = {k: v[~copy & ~crowd] for k, v in p.items()}
        part = ((p["anchor"] >> np.uint64(16)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        part, p = part[order], {k: v[order] for k, v in p.items()}
        p |= {k: _halved(p[k]) for k in ("left", "right")}
        # Within a part, documents are in order; each part numbers those that it has.
        new = _groups(part)
        first = new | _groups(p["doc"])
        used = np.cumsum(first) - 1
        head, cuts = np.flatnonzero(first), np.flatnonzero(new)
        ids, names = ids[p["doc"][head]], names[p["doc"][head]]
        p["doc"] = used - used[cuts][np.cumsum(new) - 1] if len(cuts) else used
        stops = np.r_[cuts[1:], len(part)]
        for n, a, b, c, d in zip(part[cuts].tolist(), cuts.tolist(), stops.tolist(), used[cuts].tolist(), (used[stops - 1] + 1).tolist(), strict=True) if len(cuts) else ():
            yield n, ids[c:d], names[c:d], _pack({k: v[a:b] for k, v in p.items()}), *[None] * 6

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, docs, texts, size = [], [], [], 0

        def out() -> pd.DataFrame:
            return pd.DataFrame(list(flush(held, docs, texts)), columns=[c.split()[0] for c in SHIPPED.split(", ")])

        for batch in slices(batches):
            data = [t.encode("utf-8", "replace") for t in batch["text"]]
            at = 0
            while at < len(data):
                end, length = at, 0
                while end < len(data) and (end == at or length + len(data[end]) <= CHUNK_BYTES):
                    length += len(data[end])
                    end += 1
                found = pieces(data[at:end])
                found["doc"] = found["doc"] + len(docs)
                held.append({k: v.astype(np.int32) for k, v in found.items() if k in ("doc", "lo", "hi")})
                held[-1] |= {"anchor": found["anchor"], "whole": found["whole"], "left": _halved(found["left"]), "right": _halved(found["right"])}
                docs += batch["doc_id"].iloc[at:end].tolist()
                texts += batch["text_id"].iloc[at:end].tolist()
                size, at = size + length, end
                if size >= FLUSH_BYTES or len(docs) > 60_000:
                    yield out()
                    held, docs, texts, size = [], [], [], 0
        if held:
            yield out()

    return run


def _sent(shipped):
    """What ``_shipped`` makes, with packed ids: with many parts, nearly every piece in one has an id of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in shipped(batches):
            yield frame.assign(**{c: frame[c].map(_pack_ids) for c in ("docs", "texts")})

    return run


def _shared(anchor: np.ndarray, side: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of numbered anchors and a side of their pieces (0: none), which are held by several documents."""
    ok = np.flatnonzero(side)
    key, order = bwt.in_order((anchor[ok] << 16) | side[ok].astype(np.int64))
    begins = np.flatnonzero(_groups(key))
    out = np.zeros(len(side), bool)
    if len(ok):
        of = doc[ok[order]]
        out[ok[order]] = np.repeat(np.minimum.reduceat(of, begins) < np.maximum.reduceat(of, begins), np.diff(np.r_[begins, len(ok)]))
    return out


def _compared(rows: pd.DataFrame) -> pd.DataFrame:
    """Pieces of one part: whole repeats (without buckets), and pieces to compare string by string (with their anchors).

    A string that two pieces share has the 17 bytes before or after the anchor in both, so a piece is compared only if another
    document has one of its sides. Of an anchor with more than MANY pieces to compare, the bucket is given as -1; so it is
    for those sent apart.
    """
    names = [c.split()[0] for c in COMPARED.split(", ")]
    done = []

    def add(docs, texts, lo, hi, bucket=None, *apart) -> None:
        columns = dict(zip(names, (docs, texts, lo, hi, bucket, *apart, *[None] * (len(APART) - len(apart))), strict=True))
        done.append(pd.DataFrame({c: pd.array(np.asarray(v), "Int64") if v is not None else pd.array([pd.NA] * len(lo), "Int64") for c, v in columns.items()}))

    for crowded in (False, True):
        ready = rows[rows["payload"].isna() & (rows["anchor"].notna() == crowded)]
        if len(ready):
            n = ready["lo"].map(len).to_numpy()
            flat = {c: np.concatenate(ready[c].tolist()) for c in (("lo", "hi", *APART) if crowded else ("lo", "hi"))}
            ids = (np.repeat(np.concatenate([_unpack_ids(x) for x in ready[c]]), n) for c in ("docs", "texts"))
            add(*ids, flat["lo"], flat["hi"], np.full(n.sum(), -1) if crowded else None, *(flat[c] for c in APART if crowded))
    held = []
    for docs, texts, data in zip(rows["docs"], rows["texts"], rows["payload"], strict=True):
        if data is not None:
            p = _unpack(data)
            held.append(p | {"doc": _unpack_ids(docs)[p["doc"]], "text": _unpack_ids(texts)[p["doc"]]})
    if held:
        p = {k: np.concatenate([h.pop(k) for h in held]) for k in list(held[0])}
        order = _by_anchor(p["anchor"], p["whole"])
        p = {k: v[order] for k, v in p.items()}
        doc = p["doc"]
        new_anchor = _groups(p["anchor"])
        new = new_anchor | _groups(p["whole"])
        whole = doc > np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
        anchor = np.cumsum(new_anchor) - 1
        begins = np.flatnonzero(new_anchor)
        several = (np.bincount(anchor[new]) > 1) & (np.minimum.reduceat(doc, begins) < np.maximum.reduceat(doc, begins))
        open_ = np.flatnonzero(~whole & several[anchor])
        open_ = open_[_shared(anchor[open_], p["left"][open_], doc[open_]) | _shared(anchor[open_], p["right"][open_], doc[open_])]
        crowd = (np.bincount(anchor[open_], minlength=len(begins)) > MANY)[anchor[open_]]
        for pick, n in ((whole, 0), (open_[~crowd], 1), (open_[crowd], len(APART))):
            marks, apart = [p[k][pick] for k in ("doc", "text", "lo", "hi")], [p[k][pick].astype(np.int64) for k in APART[:n]]
            # The bucket of a piece follows from its anchor.
            add(*marks, *(apart if n < 2 else [np.full(len(marks[0]), -1), *apart]))
    return pd.concat(done, ignore_index=True) if done else pd.DataFrame(columns=names)


def _cut_out(buckets: int, run_of: int = 1):
    """The bytes of the pieces to compare; of crowded anchors (bucket -1) every 50-byte string by itself.

    With ``run_of``, runs of at most so many neighbouring strings are left together. They are counted from the anchor, so
    the same strings around an anchor form the same runs.
    """

    def frames(docs: list[int], texts: list[int], data: list[bytes], refs: list[list[np.ndarray]]) -> Iterator[pd.DataFrame]:
        doc_id, text_id = np.array(docs, np.int64), np.array(texts, np.int64)
        owner = np.repeat(np.arange(len(refs)), [len(r[0]) for r in refs])
        lo, hi, anchor = (np.concatenate(c) for c in zip(*refs, strict=True))
        plain = anchor >= 0
        # Each place of a crowded piece is a string; a plain piece is one as a whole.
        n = np.where(plain, 1, hi - lo + 1)
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if run_of > 1 and not plain.all():
            crowd = np.flatnonzero(~plain)
            found = pieces([data[d][x : y + WINDOW] for d, x, y in zip(*(c[crowd].tolist() for c in (owner, lo, hi)), strict=True)])
            middle = lo.copy()
            middle[crowd[found["doc"]]] += found["at"]
            begins = (at == np.repeat(lo, n)) | ((np.repeat(middle, n) - at) % run_of == run_of - 1)
            n = np.add.reduceat(begins, np.cumsum(n) - n, dtype=np.int64)
            at = at[begins]
        ref = np.repeat(np.arange(len(lo)), n)
        # A row reaches to the next one of its piece.
        end = hi[ref] + WINDOW
        same = np.flatnonzero(ref[1:] == ref[:-1])
        end[same] = at[same + 1] + WINDOW - 1
        of, bucket = owner[ref], np.where(plain, anchor % buckets, -1)[ref]
        for a in range(0, len(at), STRINGS):
            some = slice(a, a + STRINGS)
            piece = [data[d][x:y] for d, x, y in zip(*(c[some].tolist() for c in (of, at, end)), strict=True)]
            columns = (bucket[some], doc_id[of[some]], text_id[of[some]], at[some], piece)
            yield pd.DataFrame(dict(zip(("bucket", "doc_id", "text_id", "lo", "piece"), columns, strict=True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, texts, data, refs, size = [], [], [], [], 0
        for batch in slices(batches):
            for doc, text_id, text, of_doc in zip(batch["doc_id"], batch["text_id"], batch["text"], batch["refs"], strict=True):
                lo, hi, anchor = (np.hstack([r[k] for r in of_doc]).astype(np.int64) for k in ("lo", "hi", "bucket"))
                docs.append(doc)
                texts.append(text_id)
                data.append(text.encode("utf-8", "replace"))
                refs.append([lo, hi, anchor])
                size += int(np.where(anchor < 0, hi - lo + 1, 1).sum())
                if size >= STRINGS:
                    yield from frames(docs, texts, data, refs)
                    docs, texts, data, refs, size = [], [], [], [], 0
        if docs:
            yield from frames(docs, texts, data, refs)

    return run


def repeated_strings(strings: list[bytes], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 50-byte strings inside ``strings`` that also begin in a string of a smaller ``doc``: number and place.

    Shards are transformed one by one; their interleave then gives the order of all suffixes and their common prefixes.
    """
    shards, places = [], []
    for at in range(0, len(strings), SHARD_PIECES):
        data, number, place = bwt.collection(strings[at : at + SHARD_PIECES])
        symbols, order = bwt.transform(data, number, STEP)
        shards.append(symbols)
        places.append((number[order] + at, place[order]))
    interleave, prefix = bwt.merge(shards, WINDOW, STEP)
    number, place = np.empty(len(interleave), np.int64), np.empty(len(interleave), np.int64)
    for n, (a, b) in enumerate(places):
        here = interleave == n
        number[here], place[here] = a, b
    # An interval of suffixes that share 50 bytes begins where the common prefix with the one before is shorter.
    begins = np.flatnonzero(prefix < WINDOW)
    smallest = np.minimum.reduceat(doc[number], begins)[np.cumsum(prefix < WINDOW) - 1]
    again = doc[number] > smallest
    return number[again], place[again]


def _bucket(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "text_id", "lo"], kind="stable")
    doc, text, lo = rows["doc_id"].to_numpy(), rows["text_id"].to_numpy(), rows["lo"].to_numpy()
    strings = [bytes(p) for p in rows["piece"]]
    kept, low, high = shared_parts(strings, doc)
    none = pd.DataFrame({c.split()[0]: [] for c in MARKS.split(", ")})
    if not len(kept):
        return none
    number, place = repeated_strings([strings[n][a:b] for n, a, b in zip(kept.tolist(), low.tolist(), high.tolist(), strict=True)], doc[kept])
    if not len(number):
        return none
    at = lo[kept[number]] + low[number] + place
    number = kept[number]
    source = np.cumsum(_groups(doc, text)) - 1
    head = np.flatnonzero(_groups(doc, text))
    # Places next to each other are one mark.
    order = np.lexsort((at, source[number]))
    at, of = at[order], source[number][order]
    cut = np.flatnonzero(_groups(of, at - np.arange(len(at))))
    of, end = head[of[cut]], np.r_[cut[1:], len(at)] - 1
    return pd.DataFrame({"doc_id": doc[of], "text_id": text[of], "lo": at[cut].astype(np.int32), "hi": at[end].astype(np.int32)})


REMOVED = "doc_id long, has_id boolean, n_bytes long, start array<long>, stop array<long>, kept binary"


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in slices(batches):
        out = []
        for doc, named, text, lo, hi in zip(*(batch[c] for c in ("doc_id", "has_id", "text", "lo", "hi")), strict=True):
            data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            if lo is None or not len(lo):
                out.append((doc, named, len(data), [], [], data.tobytes()))
                continue
            depth = np.zeros(len(data) + 1, np.int64)
            np.add.at(depth, lo, 1)
            np.add.at(depth, hi + WINDOW, -1)
            gone = np.cumsum(depth[:-1]) > 0
            edge = np.diff(np.r_[False, gone, False].astype(np.int8))
            out.append((doc, named, len(data), np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), data[~gone].tobytes()))
        yield pd.DataFrame(out, columns=["doc_id", "has_id", "n_bytes", "start", "stop", "kept"])


def _told_apart(ids: DataFrame, body: Column) -> Column:
    """A number that tells rows of one ``doc_id`` apart by their text, 0 for (nearly all of) the ids of one row.

    Most rows then have nothing but their id to carry along. Ids of several rows are known by a hash; where they have
    too many different ones, all rows count as such.
    """
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BUCKETS))
    several = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(bucket.alias("bucket")).distinct()
    found = [r.bucket for r in several.limit(SHARED_IDS + 1).collect()]
    if len(found) > SHARED_IDS:
        return F.xxhash64(body)
    return F.when(bucket.isin(found), F.xxhash64(body)).otherwise(F.lit(0).cast("long")) if found else F.lit(0).cast("long")


def _marks(rows: DataFrame) -> DataFrame:
    """The places (lo to hi) of the rows' 50-byte strings that a smaller document holds too."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    long_rows = rows.where(F.octet_length("text") >= WINDOW).select("doc_id", "text_id", "text")
    shipped = long_rows.mapInPandas(_sent(_shipped(parts, crowded_anchors(long_rows))), SENT)
    compared = cut_lineage(shipped.groupBy("part").applyInPandas(_compared, COMPARED))

    # Of crowded anchors, pieces that a smaller document holds whole are done; of the others, those that have a side in
    # common with another document are cut into strings.
    crowd = compared.where("anchor IS NOT NULL")
    holders = crowd.groupBy("anchor", "whole").agg(F.min("doc_id").alias("first_doc"))
    again = (F.col("doc_id") > F.col("first_doc")).alias("again")
    crowd = cut_lineage(crowd.join(holders, ["anchor", "whole"]).select("doc_id", "text_id", "lo", "hi", "bucket", "anchor", "left", "right", again))
    sides = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col(c).alias("hash")) for n, c in enumerate(("left", "right")))))
    sides = crowd.where("NOT again").select("doc_id", "text_id", "lo", "hi", "bucket", "anchor", sides.alias("side")).where("side.hash <> 0")
    shared = sides.groupBy("anchor", "side").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc")
    apart = sides.join(shared.select("anchor", "side"), ["anchor", "side"]).select("doc_id", "text_id", "lo", "hi", "bucket").distinct()

    refs = compared.where("bucket IS NOT NULL AND anchor IS NULL").select("doc_id", "text_id", "lo", "hi", "bucket")
    asked = refs.count()
    refs = refs.unionByName(apart)
    # One struct of three arrays is quicker to read than many structs.
    of_doc = refs.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("lo", "hi", "bucket")).alias("refs"))
    of_doc = of_doc.withColumn("refs", F.array(F.struct(*(F.col(f"refs.{c}").alias(c) for c in ("lo", "hi", "bucket")))))
    cut = _cut_out(max(1, -(-asked // BUCKET_PIECES)), RUN)
    cut = cut_lineage(long_rows.join(of_doc, ["doc_id", "text_id"]).mapInPandas(cut, "bucket long, doc_id long, text_id long, lo int, piece binary"))
    merged = cut.where("bucket >= 0").groupBy("bucket").applyInPandas(_bucket, MARKS).select("doc_id", "text_id", "lo", "hi")

    # Likewise, of their runs of strings only those go string by string that no smaller document holds as they are.
    runs = cut.where("bucket < 0").drop("bucket")
    first = runs.groupBy("piece").agg(F.min("doc_id").alias("first_doc"))
    runs = cut_lineage(runs.join(first, "piece").withColumn("again", again))
    single = F.expr(f"transform(sequence(0, octet_length(piece) - {WINDOW}), i -> substring(piece, i + 1, {WINDOW}))")
    strings = runs.where("NOT again").select("doc_id", "text_id", "lo", F.posexplode(single).alias("at", "piece"))
    strings = strings.select("doc_id", "text_id", (F.col("lo") + F.col("at")).alias("lo"), "piece")
    first = strings.groupBy("piece").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc")
    repeated = strings.join(first, "piece").where("doc_id > first_doc")
    marks = [
        compared.where("bucket IS NULL").select("doc_id", "text_id", "lo", "hi"),
        crowd.where("again").select("doc_id", "text_id", "lo", "hi"),
        cut_lineage(merged),
        runs.where("again").select("doc_id", "text_id", "lo", (F.col("lo") + F.octet_length("piece") - WINDOW).alias("hi")),
        cut_lineage(repeated.select("doc_id", "text_id", "lo", F.col("lo").alias("hi"))),
    ]
    return reduce(DataFrame.unionByName, marks)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, start and stop (arrays: the removed runs of bytes), kept (binary).

    A byte goes if a 50-byte string of the document that covers it begins in a document with a smaller id too. Texts are
    UTF-8 bytes, null ones empty. Rows that share an id don't make each other smaller, so neither loses what only the
    other holds; rows without an id come after all others, but beside the largest number there is.
    """
    number = F.coalesce(col(docs, doc_id).cast("long"), F.lit(LAST_ID))
    rows = docs.select(number.alias("doc_id"), text_or_empty(docs, text).alias("text"), col(docs, doc_id).cast("long").alias("id"))
    with lean_steps(docs.sparkSession):
        rows = rows.withColumn("text_id", _told_apart(rows.select("doc_id"), F.col("text")))
        marks = _marks(rows).groupBy("doc_id", "text_id").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    named = rows.select("doc_id", "text_id", "text", F.col("id").isNotNull().alias("has_id"))
    out = named.join(marks, ["doc_id", "text_id"], "left").mapInPandas(_removed, REMOVED)
    return out.withColumn("doc_id", F.when(F.col("has_id"), F.col("doc_id"))).drop("has_id")
