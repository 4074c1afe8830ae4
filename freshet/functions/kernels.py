"""Numeric kernels of recursions that SQL has no form for. Models step over days once for a whole
batch of parameter sets: every state is a vector over the sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def lyne_hollick(q: np.ndarray, alphas: np.ndarray, passes: int = 3, reflect: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Baseflow index of each alpha, and the baseflow averaged over them. The series is mirrored at both
    ends; passes run forward, backward, forward, each on the baseflow the last one left."""
    n, alphas = len(q), np.asarray(alphas, float)
    mirrored = n - 1 > reflect and reflect > 0
    x = np.concatenate((q[reflect:0:-1], q, q[-2 : -reflect - 2 : -1])) if mirrored else q.astype(float)
    base = np.repeat(x[:, None], len(alphas), axis=1)
    for number in range(1 + 2 * int(0.5 * (passes - 1))):
        if number % 2:
            base = base[::-1]
        quick = np.empty_like(base)
        quick[0] = base[0]
        step = 0.5 * (1 + alphas) * np.diff(base, axis=0)
        for j in range(len(base) - 1):
            quick[j + 1] = alphas * quick[j] + step[j]
        base = np.where(quick < 0, base, base - quick)
        if number % 2:
            base = base[::-1]
    if mirrored:
        base = base[reflect:-reflect]
    base = np.maximum(base, 0.0)
    mean = q.mean()
    return (base.mean(axis=0) / mean if mean else np.zeros(len(alphas))), base.mean(axis=1)


def cema_neige(temp: np.ndarray, rain: np.ndarray, years: np.ndarray, params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Liquid water and melt, and the snow pack, [days, sets], of params [sets, 3]: memory of the
    pack's thermal state, degree-day factor, temperature below which precipitation is snow."""
    memory, factor, limit = params.T
    solid = np.where(temp[:, None] < limit, rain[:, None], 0.0)
    each = [solid[years == y].sum(axis=0) for y in np.unique(years)]
    covered = 0.9 * np.mean(each, axis=0)
    pack, state = np.zeros(len(params)), np.zeros(len(params))
    water, packs = np.empty(solid.shape), np.empty(solid.shape)
    for t in range(len(temp)):
        pack = pack + solid[t]
        state = np.minimum(memory * np.clip(state, -1e10, 1e10) + (1 - memory) * temp[t], 0.0)
        melting = (state == 0) & (temp[t] > 0)
        potential = np.where(melting, np.minimum(factor * temp[t], pack), 0.0)
        share = np.where(pack < covered, pack / np.where(covered > 0, covered, 1.0), 1.0)
        melt = (0.9 * share + 0.1) * potential
        pack = pack - melt
        water[t], packs[t] = rain[t] - solid[t] + melt, pack
    return water, packs


def _unit_hydrograph(base: np.ndarray, length: int, double: bool) -> np.ndarray:
    """Ordinates [sets, length] of the S-curve to the power 2.5, one-sided or two-sided."""
    t = np.arange(length + 1)
    x = t[None, :] / base[:, None]
    if double:
        curve = np.where(x <= 1, 0.5 * np.minimum(x, 1) ** 2.5, 1 - 0.5 * np.clip(2 - x, 0, 1) ** 2.5)
    else:
        curve = np.minimum(x, 1) ** 2.5
    return np.diff(curve, axis=1)


def gr4j(rain: np.ndarray, pet: np.ndarray, params: np.ndarray, length: int = 20) -> np.ndarray:
    """Flow [days, sets] of params [sets, 4]: production store, exchange, routing store, time base.
    rain: [days] or [days, sets]. The unit hydrographs hold `length` and twice as many days, and only
    the first int(x4 + 1) (twice that) of them advance, as published."""
    x1, x2, x3, x4 = params.T
    rain = np.repeat(rain[:, None], len(params), axis=1) if rain.ndim == 1 else rain
    hydro = [(_unit_hydrograph(x4, length * m, m == 2), np.minimum(length * m - 1, m * (x4 + 1).astype(int))) for m in (1, 2)]
    moving = [np.arange(h.shape[1])[None, :] < np.maximum(size, 1)[:, None] for h, size in hydro]
    states = [np.zeros_like(h) for h, _ in hydro]
    store, routed = x1 / 2, x3 / 2
    out = np.empty(rain.shape)
    for t in range(len(rain)):
        dry = rain[t] <= pet[t]
        surplus = np.abs(rain[t] - pet[t])
        w = np.tanh(np.minimum(13.0, surplus / x1))
        level = store / x1
        loss = store * (2 - level) * w / (1 + (1 - level) * w)
        gain = x1 * (1 - level * level) * w / (1 + level * w)
        store = np.where(dry, store - loss, store + gain)
        leak = store * (1 - (1 + (store / x1) ** 4 / 25.62891) ** -0.25)
        store = store - leak
        effective = np.where(dry, 0.0, surplus - gain) + leak
        for k, share in enumerate((0.9, 0.1)):
            ordinates, state = hydro[k][0], states[k]
            new = np.empty_like(state)
            new[:, :-1] = state[:, 1:] + ordinates[:, :-1] * (share * effective)[:, None]
            new[:, -1] = ordinates[:, -1] * share * effective
            keep = moving[k].copy()
            keep[:, -1] = True
            states[k] = np.where(keep, new, state)
        exchange = x2 * (routed / x3) ** 3.5
        routed = np.maximum(0.0, routed + states[0][:, 0] + exchange)
        flow = routed * (1 - (1 + (routed / x3) ** 4) ** -0.25)
        routed = routed - flow
        out[t] = flow + np.maximum(0.0, states[1][:, 0] + exchange)
    return out


def butterworth(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the digital low-pass filter; cutoff is a share of the Nyquist frequency."""
    warped = 4 * np.tan(np.pi * cutoff / 2)
    k = np.arange(order)
    poles = warped * np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    digital = (4 + poles) / (4 - poles)
    gain = np.real(warped**order / np.prod(4 - poles))
    return gain * np.real(np.poly(-np.ones(order))), np.real(np.poly(digital))


def linear_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """y[t] = sum(b * x[t - k]) - sum(a[1:] * y[t - k]) along the first axis, from rest."""
    out = np.zeros(x.shape)
    for t in range(len(x)):
        y = sum(b[k] * x[t - k] for k in range(min(t + 1, len(b))))
        for k in range(1, min(t + 1, len(a))):
            y = y - a[k] * out[t - k]
        out[t] = y
    return out


#: Names of HBV's parameters, in order.
HBV_NAMES = "beta cet fc k0 k1 k2 lp maxbas perc uzl pcorr tt cfmax sfcf cfr cwh".split()


def hbv(temp: np.ndarray, rain: np.ndarray, evap: np.ndarray, day: np.ndarray, params: np.ndarray) -> np.ndarray:
    """Flow [days, sets] of params [sets, 16] in the order of HBV_NAMES: degree-day snow with
    refreezing, soil moisture, two groundwater boxes, and a Butterworth filter as routing. Evaporation
    is corrected by the temperature's anomaly from the mean of its day of the year."""
    p = dict(zip(HBV_NAMES, params.T))
    days, sets = len(rain), len(params)
    wet = p["pcorr"] * rain[:, None]
    warm = temp[:, None] > p["tt"]
    liquid, snow = np.where(warm, wet, 0.0), np.where(warm, 0.0, wet) * p["sfcf"]
    sums = np.bincount(day, temp, 367) / np.maximum(np.bincount(day, minlength=367), 1)
    corrected = np.where(p["cet"] > 0, (1 + p["cet"] * (temp - sums[day])[:, None]) * evap[:, None], evap[:, None])
    corrected = np.maximum(corrected, 0.0)
    pack, melted, soil, upper, lower = (np.full(sets, 1e-4) for _ in range(5))
    out = np.empty((days, sets))
    out[0] = 1e-4
    fc, limit = p["fc"], p["lp"] * p["fc"]
    for t in range(1, days):
        pack = pack + snow[t]
        melt = np.minimum(np.maximum(p["cfmax"] * (temp[t] - p["tt"]), 0.0), pack)
        pack, melted = pack - melt, melted + melt
        frozen = np.minimum(np.maximum(p["cfr"] * p["cfmax"] * (p["tt"] - temp[t]), 0.0), melted)
        pack, melted = pack + frozen, melted - frozen
        inflow = np.maximum(melted - p["cwh"] * pack, 0.0)
        melted = melted - inflow
        wetness = np.where(fc > 0, np.clip((soil / np.where(fc > 0, fc, 1.0)) ** p["beta"], 0.0, 1.0), 0.0)
        recharge = (liquid[t] + inflow) * wetness
        soil = soil + liquid[t] + inflow - recharge
        excess = np.maximum(soil - fc, 0.0)
        soil = soil - excess
        share = np.where(limit > 0, np.clip(soil / np.where(limit > 0, limit, 1.0), 0.0, 1.0), 0.0)
        soil = np.maximum(soil - np.minimum(corrected[t] * share, soil), 0.0)
        upper = upper + recharge + excess
        seep = np.minimum(p["perc"], upper)
        upper = upper - seep
        quick = p["k0"] * np.maximum(upper - p["uzl"], 0.0)
        upper = upper - quick
        middle = p["k1"] * upper
        lower = lower + seep
        slow = p["k2"] * lower
        upper, lower = np.maximum(upper - middle, 0.0), np.maximum(lower - slow, 0.0)
        out[t] = quick + middle + slow
    for order in np.unique(p["maxbas"].astype(int)).tolist():
        if order > 1:
            own = p["maxbas"].astype(int) == order
            out[:, own] = np.maximum(linear_filter(*butterworth(order, 1 / order), out[:, own]), 0.0)
    return out


#: Bounds of the models' parameters (fixed values).
GR4J_BOUNDS = [(10.0, 3000.0), (-20.0, 10.0), (1.0, 4000.0), (0.05, 20.0)]
SNOW_BOUNDS = [(0.0, 3.0), (1.0, 10.0), (-1.5, 3.0)]
HBV_BOUNDS = [
    (1.0, 6.0), (0.0, 0.3), (50.0, 500.0), (0.01, 0.4), (0.01, 0.4), (0.001, 0.15), (0.3, 1.0), (1.0, 7.0), (0.0, 3.0), (0.0, 500.0),
    (0.5, 2.0), (-1.5, 2.5), (1.0, 10.0), (0.4, 1.0), (0.0, 0.1), (0.0, 0.2),
]


def smoothed_cycle(x: np.ndarray, middle: int = 5, width: int = 11, degree: int = 3, sigma: float = 3.0) -> np.ndarray:
    """A seasonal cycle without spikes: values further than sigma deviations from the running median are
    replaced along the line between their neighbours, then a least-squares polynomial runs over it. The
    ends of the year meet."""
    x = np.asarray(x, float).copy()
    n = len(x)
    at = (np.arange(n)[:, None] + np.arange(-(middle // 2), middle // 2 + 1)) % n
    away = np.abs(x - np.median(x[at], axis=1))
    spikes = away > away.std() * sigma
    if spikes.any() and (~spikes).sum() > 1:
        x[spikes] = np.interp(np.flatnonzero(spikes), np.flatnonzero(~spikes), x[~spikes])
    half = width // 2
    weights = np.linalg.pinv(np.vander(np.arange(-half, half + 1), degree + 1, increasing=True))[0]
    at = (np.arange(n)[:, None] + np.arange(-half, half + 1)) % n
    return x[at] @ weights


def padded(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values [rows, widest], where they are there, and which rows are not null; the rest is 0."""
    starts = vectors.offsets.to_numpy().astype(np.int64)
    whole = vectors.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(whole, np.diff(starts), 0)
    there = np.arange(sizes.max(initial=0)) < sizes[:, None]
    at = (starts[:-1, None] + np.arange(there.shape[1]))[there]
    flat = vectors.values.take(pa.array(at))
    values = np.zeros(there.shape)
    values[there] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    there[there] = flat.is_valid().to_numpy(zero_copy_only=False)
    return values, there, whole


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


class Distances:
    """Euclidean distances to fixed points y [m, width]; a component that either side lacks (there False)
    counts as 0. Products of matrices give them, from values less the points' mean; where the difference
    would lose digits, or a value is not finite, the components are subtracted one by one."""

    #: Least share of a squared distance in the sum of squares for which the product's digits do.
    LOSS = 1e-6

    def __init__(self, y: np.ndarray, hers: np.ndarray):
        self.y, self.hers, self.all = y, hers, bool(hers.all())
        use = hers & np.isfinite(y)
        self.centre = np.where(use, y, 0.0).sum(axis=0) / np.maximum(use.sum(axis=0), 1)
        self.moved = np.where(hers, y - self.centre, 0.0)
        self.squares = self.moved**2
        sums = self.squares.sum(axis=1)
        self.right = np.column_stack((self.moved, np.ones(len(y)), sums)).T
        self.largest = sums[np.isfinite(sums)].max(initial=0.0)

    def to(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """[rows of x, m]"""
        with np.errstate(invalid="ignore", over="ignore"):
            moved = np.where(own, x - self.centre, 0.0)
            if self.all and own.all():
                squares = (moved**2).sum(axis=1)
                out = np.column_stack((-2.0 * moved, squares, np.ones(len(x)))) @ self.right
                least = self.LOSS * (squares[:, None] + self.largest)
            else:
                scale = moved**2 @ self.hers.T + own @ self.squares.T
                out = scale - 2.0 * (moved @ self.moved.T)
                least = self.LOSS * scale
            near = np.flatnonzero(~(out > least))
            step = max(1, 1_000_000 // max(1, x.shape[1]))
            for low in range(0, len(near), step):
                i, j = np.divmod(near[low : low + step], len(self.y))
                out[i, j] = (np.where(own[i] & self.hers[j], x[i] - self.y[j], 0.0) ** 2).sum(axis=1)
            return np.sqrt(out, out=out)


class _Ward:
    """Clusters that remain to be merged, in slots. The cost of a merge is the growth of the sum of squares."""

    def __init__(self, centre: np.ndarray, size: np.ndarray, name: np.ndarray):
        self.centre, self.size, self.name = centre.copy(), size.astype(float), name
        self.middle = centre.mean(axis=0)
        self.moved = centre - self.middle  # for products: differences come from centre
        self.height, self.alive = np.zeros(len(centre)), np.ones(len(centre), bool)
        self.squares = (self.moved**2).sum(axis=1)
        self.right = np.column_stack((self.moved, np.ones(len(centre)), self.squares))  # a free slot is infinitely far
        self.merges: list[tuple[float, int, int]] = []

    def cost(self, a, b):
        """The same number for (a, b) and (b, a), which products of matrices do not promise."""
        weight = self.size[a] * self.size[b] / (self.size[a] + self.size[b])
        return ((self.centre[a] - self.centre[b]) ** 2).sum(axis=-1) * weight

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cheapest partner of every row, the first slot of equal ones, and its cost. Products of
        matrices choose all partners that may be it, the direct difference decides."""
        partner, price = np.empty(len(rows), np.int64), np.empty(len(rows))
        if not len(rows):
            return partner, price
        inverse = 1 / self.size
        error = 4 * (self.centre.shape[1] + 8) * np.finfo(float).eps * (self.squares[rows] + self.squares.max()) * self.size[rows]
        step = max(1, 4_000_000 // len(self.centre))
        for low in range(0, len(rows), step):
            own = rows[low : low + step]
            costs = np.column_stack((-2.0 * self.moved[own], self.squares[own], np.ones(len(own)))) @ self.right.T
            costs /= inverse[own, None] + inverse
            costs[np.arange(len(own)), own] = np.inf
            found = np.flatnonzero(costs <= (costs.min(axis=1) + 2 * error[low : low + step])[:, None])
            may = np.column_stack(np.divmod(found, len(self.centre)))
            wide = max(1, 1_000_000 // max(1, self.centre.shape[1]))
            exact = np.concatenate([self.cost(own[may[k : k + wide, 0]], may[k : k + wide, 1]) for k in range(0, len(may), wide)])
            order = np.lexsort((may[:, 1], exact, may[:, 0]))
            best = order[np.searchsorted(may[order, 0], np.arange(len(own)))]
            partner[low : low + step], price[low : low + step] = may[best, 1], exact[best]
        return partner, price

    def merge(self, a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> None:
        """Each b joins its a. A merge is never lower than those inside it."""
        height = np.maximum(cost, np.maximum(self.height[a], self.height[b]))
        self.merges += zip(height.tolist(), self.name[a].tolist(), self.name[b].tolist())
        total = self.size[a] + self.size[b]
        self.centre[a] = (self.centre[a] * self.size[a, None] + self.centre[b] * self.size[b, None]) / total[:, None]
        self.size[a], self.height[a], self.alive[b] = total, height, False
        self.moved[a], self.moved[b] = self.centre[a] - self.middle, 0.0
        self.squares[a], self.squares[b] = (self.moved[a] ** 2).sum(axis=1), 0.0
        self.right[a] = np.column_stack((self.moved[a], np.ones(len(a)), self.squares[a]))
        self.right[b, :-2], self.right[b, -1] = 0.0, np.inf

    def compact(self) -> np.ndarray:
        """Remove the free slots; gives the new number of each old one."""
        number = np.cumsum(self.alive) - 1
        for field in ("centre", "moved", "right", "size", "name", "height", "squares"):
            setattr(self, field, getattr(self, field)[self.alive])
        self.alive = np.ones(len(self.size), bool)
        return number

    def rounds(self, dear: int = 20) -> None:
        """Merge all pairs that are each other's cheapest partners at once: a merge brings no cluster
        nearer to a third, so all others keep theirs. A cluster that lost its partner looks for another
        when one that has its own wants it, or when nothing else is left to do. Ends where a merge asks
        for more than `dear` searches."""
        partner, price = self.nearest(np.arange(len(self.size)))
        stale, left, searches, merges = np.zeros(len(self.size), bool), len(self.size), 0, 0
        while True:
            slots = np.flatnonzero(self.alive & ~stale)
            a = slots[(partner[partner[slots]] == slots) & ~stale[partner[slots]] & (slots < partner[slots])]
            if not len(a) and not (stale & self.alive).any():  # equal costs may run in a circle: the cheapest of all is right in any case
                a = slots[[np.argmin(price[slots])]]
            if len(a):
                b = partner[a]
                self.merge(a, b, price[a])
                left -= len(a)
                merges += len(a)
                if left == 1:
                    return
                gone = np.zeros(len(self.size), bool)
                gone[a] = gone[b] = True
                stale |= gone | gone[partner]
                if left < 0.7 * len(self.alive):
                    stale, price, partner = stale[self.alive], price[self.alive], partner[self.alive]
                    partner = self.compact()[partner]
            wanted = np.zeros(len(self.size), bool)
            wanted[partner[self.alive & ~stale]] = True
            again = np.flatnonzero(stale & self.alive & wanted)
            if not len(again) and not len(a):
                again = np.flatnonzero(stale & self.alive)
            searches += len(again)
            if searches > max(64, dear * merges):
                return
            partner[again], price[again] = self.nearest(again)
            stale[again] = False

    def chain(self) -> None:
        """Merge what is left along chains of cheapest partners: three searches a merge at most."""
        chain: list[int] = []
        prices: list[float] = []
        left = int(self.alive.sum())
        while left > 1:
            if not chain:
                if left < 0.7 * len(self.alive):
                    self.compact()
                chain = [int(np.argmax(self.alive))]
            partner, price = self.nearest(np.array(chain[-1:]))
            if prices and prices[-1] <= price[0]:
                b, a = chain.pop(), chain.pop()
                self.merge(np.array([a]), np.array([b]), np.array([prices.pop()]))
                prices = prices[: max(0, len(chain) - 1)]
                left -= 1
            else:
                chain.append(int(partner[0]))
                prices.append(float(price[0]))


def ward_labels(x: np.ndarray, clusters: int) -> np.ndarray:
    """Labels 1 to clusters of Ward's hierarchical clustering; numbered by the first member. Memory grows
    with the points, time with their square; equal points are one from the beginning."""
    n = len(x)
    if not n:
        return np.empty(0, np.int64)
    x = np.asarray(x, float) + 0.0
    _, first, kind, size = np.unique(x, axis=0, return_index=True, return_inverse=True, return_counts=True)
    kind, order = kind.ravel(), np.argsort(first)
    todo = _Ward(x[first[order]], size[order], first[order])
    if len(first) > 1:
        todo.rounds()
        todo.chain()
    copies = np.flatnonzero(first[kind] != np.arange(n))
    merges = [(0.0, int(first[kind[i]]), int(i)) for i in copies] + todo.merges
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[: max(0, n - clusters)]:
        up[find(b)] = find(a)
    roots: dict[int, int] = {}
    return np.array([roots.setdefault(find(i), len(roots) + 1) for i in range(n)])


def clipped_area(polygon: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> float:
    """Area of a polygon (ring of points) inside a rectangle, in the units of its coordinates."""
    ring = [tuple(p) for p in polygon]
    for axis, bound, keep_less in ((0, x0, False), (0, x1, True), (1, y0, False), (1, y1, True)):
        out = []
        for i, p in enumerate(ring):
            q = ring[i - 1]
            inside, before = ((v <= bound) if keep_less else (v >= bound) for v in (p[axis], q[axis]))
            if inside != before:
                t = (bound - q[axis]) / (p[axis] - q[axis])
                out.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if inside:
                out.append(p)
        ring = out
        if not ring:
            return 0.0
    return 0.5 * abs(sum(ring[i - 1][0] * p[1] - p[0] * ring[i - 1][1] for i, p in enumerate(ring)))
