"""Inverted lists in buckets: postings travel as packed records, and each list's members are compared with the earlier
ones, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from threadmill.llm.common import MIX, scramble

#: Lists up to this long are compared all at once; rows of a longer one that are compared with its hubs at a time.
SHORT, ROWS = 256, 64
#: Pairs of short lists that are compared at once, about.
PAIRS = 1 << 17
#: Postings that a task gathers before it deals them out.
HELD = 1 << 16


def buckets(partitions: int) -> int:
    """Into how many buckets postings are dealt: some for each partition, so that their sizes even out."""
    return min(1 << 16, max(64, 8 * partitions))


def dealt(records: np.ndarray, by: np.ndarray, n: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed records) for each bucket `by` % n that has some."""
    if not len(records):
        return
    bucket = (by % np.uint64(n)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
    for low, high in zip(cuts, [*cuts[1:], len(records)], strict=True):
        yield int(bucket[low]), records[low:high].tobytes()


def gathered(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """(bucket, payloads) of each bucket, the payloads put together, of rows that are sorted by bucket."""
    now, parts = None, [[] for _ in names]
    for batch in batches:
        for bucket, *payload in zip(batch.column("bucket").to_pylist(), *(batch.column(n).to_pylist() for n in names), strict=True):
            if bucket != now and now is not None:
                yield now, *(b"".join(p) for p in parts)
                parts = [[] for _ in names]
            now = bucket
            for p, x in zip(parts, payload, strict=True):
                if x:
                    p.append(x)
    if now is not None:
        yield now, *(b"".join(p) for p in parts)


def listed(words: np.ndarray, rank: np.ndarray, first: np.ndarray, size: np.ndarray, long: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, list, place) under which sets are listed.  `words` holds the sets one after the other, each in the common order,
    `first` and `size` where; a set is listed under its first `long` words.  A word whose `rank` is `hot` or more is listed
    together with each later word of the prefix, one word longer: two sets that match share their first common word within
    both prefixes, and a second one within both prefixes and that word."""
    which = np.repeat(np.arange(len(size)), long)
    pos = np.arange(len(which)) - np.repeat(np.cumsum(long) - long, long)
    at = first[which] + pos
    is_hot = rank[at] >= hot
    one = (which[~is_hot], words[at[~is_hot]], pos[~is_hot])
    if not is_hot.any():
        return one
    which, pos, at = which[is_hot], pos[is_hot], at[is_hot]
    later = np.minimum(long + 1, size)[which] - 1 - pos
    nth = np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later)
    which, pos, at = np.repeat(which, later), np.repeat(pos, later), np.repeat(at, later)
    both = scramble(scramble(words[at] ^ MIX) + words[at + 1 + nth])
    return tuple(np.concatenate(x) for x in zip(one, (which, both, pos), strict=True))


def rarity(counts: np.ndarray) -> np.ndarray:
    """The place of each cell in the order of rarity, in steps of a quarter of a doubling (0 to 255)."""
    return np.minimum(np.floor(np.log2(counts + 1.0) * 4), 255).astype(np.uint8)


def hot_rank(hot: int) -> int:
    """The least rank whose counts are all above `hot`; cells of lower rank hold 2**0.25 times `hot` words at most."""
    return int(np.ceil(np.log2(hot + 1.0) * 4))


def in_lists(key: np.ndarray) -> np.ndarray:
    """The rows whose key another row has too."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    return order[np.append(same, False) | np.append(False, same)] if len(key) else order


class Lists:
    """Compares the members of lists, the later with the earlier ones.

    A subclass says which pairs may match and how far apart they seem (`possible`).  A member keeps its `kept` nearest
    candidates of a list, ranked from 0; `more` says that there were others, or that the member stands beyond the first
    `hubs` of its list, which alone it is compared with.  Members that are marked in `whole` are compared with all
    earlier ones and keep all candidates.  With `first`, a member keeps the first candidate of its list too: where all members of a list are
    alike, they then share one."""

    first = False

    def __init__(self, hubs: int, kept: int):
        self.hubs, self.kept = hubs, kept

    def possible(self, x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs (i, j) may match, and how far apart they seem."""
        raise NotImplementedError

    def pairs(self, x: dict[str, np.ndarray], key: np.ndarray, whole: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(member, earlier member or itself, rank or -1, more) of rows sorted by the list `key` and their order in it.  With
        `whole`, of its members only."""
        n = len(key)
        if not n:
            return
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, n))
        # short lists: as many at once as make about PAIRS pairs
        short = sizes <= SHORT
        work = np.cumsum(np.where(short, sizes * (sizes - 1) // 2, 0))
        cuts = np.searchsorted(work, np.arange(PAIRS, int(work[-1]) + PAIRS, PAIRS)).clip(max=len(sizes) - 1) + 1
        low = 0
        for high in np.unique(cuts).tolist():
            which = np.flatnonzero(short[low:high]) + low
            low = high
            size = sizes[which]
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            row, found = np.repeat(starts[which], size) + nth, []
            if whole is not None:
                nth = np.where(whole[row], nth, 0)
            for back in range(1, int(size.max(initial=0))):
                active = nth >= back
                row, nth = row[active], nth[active]
                if not len(row):
                    break
                ok, apart = self.possible(x, row, row - back)
                found.append((row[ok], row[ok] - back, apart[ok]))
            if found:
                yield self._ranked(*(np.concatenate([f[k] for f in found]) for k in range(3)), None, whole is not None)
        for start, size in zip(starts[~short].tolist(), sizes[~short].tolist(), strict=True):
            members = np.arange(start + 1, start + size) if whole is None else start + np.flatnonzero(whole[start : start + size])
            reach = size if whole is not None else max(1, min(size, self.hubs))
            rows = max(1, min(ROWS, (ROWS << 12) // reach))
            for low in range(0, len(members), rows):
                some = members[low : low + rows]
                i, j = np.repeat(some, reach), np.tile(np.arange(start, start + reach), len(some))
                earlier = j < i
                i, j = i[earlier], j[earlier]
                ok, apart = self.possible(x, i, j)
                yield self._ranked(i[ok], j[ok], apart[ok], some[some - start >= reach], whole is not None)

    def _ranked(self, i, j, apart, far, everything):
        by = np.lexsort((j, apart, i))
        i, j = i[by], j[by]
        member, first, count = np.unique(i, return_index=True, return_counts=True)
        rank = np.arange(len(i)) - np.repeat(first, count)
        if everything:
            return i, j, rank.astype(np.int32), np.zeros(len(i), bool)
        over = np.repeat(count > self.kept, count)
        lead = j == np.repeat(np.minimum.reduceat(j, first), count) if self.first and len(j) else np.zeros(len(j), bool)
        if far is not None and len(far):
            over |= np.isin(i, far)
            alone = np.setdiff1d(far, member)
            i, j, rank, over = np.concatenate([i, alone]), np.concatenate([j, alone]), np.concatenate([rank, np.full(len(alone), -1)]), np.concatenate([over, np.ones(len(alone), bool)])
        keep = rank < self.kept
        keep[: len(lead)] |= lead
        return i[keep], j[keep], rank[keep].astype(np.int32), over[keep]
