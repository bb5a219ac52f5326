"""Which of many Gaussian classes score best at a point, without scoring all of them.

The space of the features is cut into boxes. Within a box a class is dropped if another one scores more in all of it,
beyond any rounding. As the logarithm of a density is a sum of parabolas, the greatest difference of two scores over a box is
known exactly. What is left in a box is scored by the plain formula, so classes, scores and ties come out as if
every class had been scored.
"""

from __future__ import annotations

import numpy as np

#: Boxes with so few classes are not cut; beyond so many a box's rows are scored class block by class block.
FEW_CLASSES, MANY_CLASSES = 16, 1024
#: Pairs (box, class) of an index, or three for each class, and those worked on at once.
INDEX_PAIRS, PAIRS_AT_ONCE = 2_000_000, 500_000
CLASS_BLOCK = 256
#: Relative slack for the rounding of a score of no feature and of each feature, far above that of doubles.
SLACK = 1e-13


class Classes:
    """Scores of classes in ascending order, given mean[feature, class], var[feature, class] and constant[class]."""

    def __init__(self, mean: np.ndarray, var: np.ndarray, constant: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            self.mean, self.twice, self.constant = mean, 2 * var, constant
            self.low, self.high = low, high
            plain = np.isfinite(constant) & np.isfinite(mean).all(0) & np.isfinite(self.twice).all(0)
            nan = np.isnan(constant) | np.isnan(mean).any(0) | np.isnan(var).any(0)  # the score is NaN everywhere: the last of them beats the others
            usual = self._undominated(np.flatnonzero(plain))
            self.odd = np.union1d(np.flatnonzero(~plain & ~nan), np.flatnonzero(nan)[-1:]).astype(np.int64)
            #: Rows with an infinite or missing number: all usual classes score alike.
            self.edge = np.union1d(self.odd, usual[-1:]).astype(np.int64)
            self._cut(usual)

    def _undominated(self, of: np.ndarray) -> np.ndarray:
        """Without classes that differ from a later one in nothing but a constant that is no greater."""
        keys = [*self.mean[:, of], *self.twice[:, of]]
        order = np.lexsort([-of, *keys])
        first = np.zeros(len(of), bool)
        first[:1] = True
        for k in keys:
            first[1:] |= k[order][1:] != k[order][:-1]
        rank = np.unique(self.constant[of], return_inverse=True)[1][order]
        most = np.maximum.accumulate(np.cumsum(first) * (len(of) + 1) + rank)
        kept = np.ones(len(of), bool)
        kept[1:] = most[1:] > most[:-1]
        return np.sort(of[order[kept]])

    def _cut(self, usual: np.ndarray) -> None:
        """Boxes as a tree (feature, cut, first child) and the classes of each leaf, level by level."""
        f, size = len(self.mean), np.array([len(usual)])
        low, high = self.low[:, None].copy(), self.high[:, None].copy()
        here, node, idle = usual.astype(np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        scale = np.sqrt(np.median(self.twice[:, usual], 1)) if len(usual) else np.ones(f)
        nodes, leaves, sizes, lists, done, most = 1, 0, [], [], 0, max(INDEX_PAIRS, 3 * len(usual))
        feature, cut, child, leaf = np.zeros(1, np.int16), np.zeros(1), np.full(1, -1), np.full(1, -1)
        if not np.isfinite([low, high]).all():
            idle[:] = 99
        while len(node):
            # the widest side in terms of the classes' own width, cut in the middle
            side = ((high - low) / scale[:, None]).argmax(0)
            at = np.arange(len(node))
            middle = low[side, at] / 2 + high[side, at] / 2
            split = (size > FEW_CLASSES) & (idle < 3 + 2 * f) & (middle > low[side, at]) & (middle < high[side, at])
            halves = None
            if split.any():
                halves = self._halves(here, size, np.flatnonzero(split), side, middle, low, high)
                if done + size[~split].sum() + halves[1].sum() > most:
                    split[:], halves = False, None
            for_good = np.repeat(~split, size)
            leaf[node[~split]] = leaves + np.arange((~split).sum())
            leaves += (~split).sum()
            sizes.append(size[~split])
            lists.append(here[for_good])
            done += size[~split].sum()
            if halves is None:
                break
            parents, k = node[split], int(split.sum())
            feature[parents], cut[parents], child[parents] = side[split], middle[split], nodes + 2 * np.arange(k)
            feature, cut = np.append(feature, np.zeros(2 * k, np.int16)), np.append(cut, np.zeros(2 * k))
            child, leaf = np.append(child, np.full(2 * k, -1)), np.append(leaf, np.full(2 * k, -1))
            node = nodes + np.arange(2 * k)
            nodes += 2 * k
            here, was, idle = halves[0], np.repeat(size[split], 2), np.repeat(idle[split], 2)
            size, low, high = halves[1:]
            no_gain = np.repeat((size > 0.8 * was).reshape(-1, 2).all(1), 2)
            idle = np.where(no_gain, idle + 1, 0)
        self.feature, self.cut, self.child, self.leaf = feature, cut, child, leaf
        self.size = np.concatenate(sizes)
        self.start = np.cumsum(self.size) - self.size
        self.lists = np.concatenate(lists)

    def _halves(self, here, size, parents, side, middle, low, high):
        """The classes left in both halves of each parent box: (classes, their number by half, low, high)."""
        out, counts, lows, highs, ends = [], [], [], [], np.cumsum(size)
        steps = np.cumsum(2 * size[parents]) // PAIRS_AT_ONCE
        for step in np.unique(steps):
            p = parents[steps == step]
            box = np.repeat(p, 2)
            lo, hi, right = low[:, box].copy(), high[:, box].copy(), np.arange(len(box)) % 2 == 1
            i = np.arange(len(box))
            lo[side[box][right], i[right]] = middle[box][right]
            hi[side[box][~right], i[~right]] = middle[box][~right]
            n = size[box]
            pair_box, first = np.repeat(i, n), np.cumsum(n) - n
            classes = here[np.arange(n.sum()) - np.repeat(first - (ends[box] - n), n)]
            kept = self._may_win(classes, pair_box, first, lo, hi)
            out.append(classes[kept])
            counts.append(np.bincount(pair_box[kept], minlength=len(box)))
            lows.append(lo)
            highs.append(hi)
        return np.concatenate(out), np.concatenate(counts), np.concatenate(lows, 1), np.concatenate(highs, 1)

    def _may_win(self, classes, box, first, lo, hi) -> np.ndarray:
        """Which pairs (class, box) are not beaten all over the box by the class that is best in its middle."""
        centre, f = lo / 2 + hi / 2, len(lo)
        score = self.constant[classes] - sum((centre[i][box] - self.mean[i][classes]) ** 2 / self.twice[i][classes] for i in range(f))
        top = np.maximum.reduceat(score, first)
        best = np.empty(len(first), classes.dtype)
        is_top = score == top[box]
        best[box[is_top]] = classes[is_top]
        return np.concatenate([self._ahead(classes[a:a + PAIRS_AT_ONCE], best[box[a:a + PAIRS_AT_ONCE]], box[a:a + PAIRS_AT_ONCE], lo, hi)
                               for a in range(0, len(classes), PAIRS_AT_ONCE)])

    def _ahead(self, classes, rival, box, lo, hi) -> np.ndarray:
        """Whether a class may reach its rival's score somewhere in the box; the slack is in the class's favour."""
        slack = SLACK * (10 + len(lo))
        ahead = self.constant[classes] - self.constant[rival] + slack * (1 + abs(self.constant[classes]) + abs(self.constant[rival]))
        for i in range(len(lo)):
            m, other = self.mean[i][classes], self.mean[i][rival]
            w, v = (1 - slack) / self.twice[i][classes], (1 + slack) / self.twice[i][rival]
            left, right = lo[i][box] - other, hi[i][box] - other
            at_left, at_right = v * left ** 2 - w * (lo[i][box] - m) ** 2, v * right ** 2 - w * (hi[i][box] - m) ** 2
            most, apart, steeper = np.maximum(at_left, at_right), m - other, w - v
            # between the ends it is greatest where the slopes are equal, if the class is the narrower one
            peak, near = w * apart / steeper, 1e-6 * (abs(left) + abs(right))
            inside = (steeper > 0) & ~((peak < left - near) | (peak > right + near))
            most = np.where(inside, np.fmax(most, apart ** 2 * w * v / steeper), most)
            ahead = ahead + most + 1e-2 * slack * v * np.maximum(left ** 2, right ** 2)
        return ~(ahead < 0)

    def best(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of points x[feature, row], the best score and its class, the greatest of equal ones."""
        n = x.shape[1]
        score, at = np.full(n, -np.inf), np.zeros(n, np.int64)

        def score_all(rows: np.ndarray, classes: np.ndarray) -> None:
            score[rows], at[rows] = self._scan(x[:, rows], classes)

        with np.errstate(all="ignore"):
            number = np.isfinite(x).all(0)
            inside = number & (x >= self.low[:, None]).all(0) & (x <= self.high[:, None]).all(0)
            for rows, classes in ((np.flatnonzero(~number), self.edge), (np.flatnonzero(number & ~inside), np.arange(len(self.constant)))):
                if len(rows):
                    score_all(rows, classes)
            rows = np.flatnonzero(inside)
            if len(rows):
                self._by_leaf(x, rows, score, at, score_all)
                if len(self.odd):
                    value, which = self._scan(x[:, rows], self.odd)
                    better = (value > score[rows]) | ((value == score[rows]) & (which > at[rows])) | (len(self.lists) == 0)
                    score[rows], at[rows] = np.where(better, value, score[rows]), np.where(better, which, at[rows])
        return score, at

    def _by_leaf(self, x, rows, score, at, score_all) -> None:
        if not len(self.lists):
            return
        node = np.zeros(len(rows), np.int64)
        while (inner := np.flatnonzero(self.child[node] >= 0)).size:
            k = node[inner]
            node[inner] = self.child[k] + (x[self.feature[k], rows[inner]] > self.cut[k])
        leaf = self.leaf[node]
        n = self.size[leaf]
        wide = n > MANY_CLASSES
        for one in np.unique(leaf[wide]):
            score_all(rows[leaf == one], self.lists[self.start[one]:self.start[one] + self.size[one]])
        rows, leaf, n = rows[~wide], leaf[~wide], n[~wide]
        steps = np.cumsum(n) // PAIRS_AT_ONCE
        edges = [0, *(np.flatnonzero(np.diff(steps)) + 1), len(rows)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            some, first = n[a:b], np.cumsum(n[a:b]) - n[a:b]
            pair = np.repeat(np.arange(b - a), some)
            classes = self.lists[np.arange(some.sum()) + np.repeat(self.start[leaf[a:b]] - first, some)]
            here = x[:, rows[a:b]]
            rest = sum((here[i][pair] - self.mean[i][classes]) ** 2 / self.twice[i][classes] for i in range(len(x)))
            value = self.constant[classes] - rest
            top = np.maximum.reduceat(value, first)
            score[rows[a:b]] = top
            at[rows[a:b]] = np.maximum.reduceat(np.where(value == top[pair], classes, -1), first)

    def _scan(self, x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best of the given classes, all of which are scored."""
        score, at = np.full(x.shape[1], -np.inf), np.full(x.shape[1], of[0], np.int64)
        for first in range(0, len(of), CLASS_BLOCK):
            block = of[first:first + CLASS_BLOCK]
            rest = sum((x[i][:, None] - self.mean[i][None, block]) ** 2 / self.twice[i][None, block] for i in range(len(x)))
            here = self.constant[None, block] - rest
            here = np.where(np.isnan(here), np.inf, here)  # as the greatest number
            top = here.shape[1] - 1 - here[:, ::-1].argmax(1)
            value = here[np.arange(len(top)), top]
            new = value >= score
            score, at = np.where(new, value, score), np.where(new, block[top], at)
        return score, at
