"""The options of a large catalogue that a profile's list can hold, found without a row per pair.

The catalogue is held once per worker, in order of name and id. A fit reads few
columns of an option, so options are grouped by what each fit reads and a
profile's fits are evaluated once per group; an option's bound is the sum of
what its groups give it, with a full financial fit. The best few by bound are
scored first, and only options whose bound reaches the last of those are scored
as well. The arithmetic is that of ``fits``, step by step, so no option of a
list is missed by rounding; what is found is scored by ``fits`` again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from waymark import fixed
from waymark.operators import pairs as P

#: Options scored for a first bound, options that are bounded at a time, group results held for a run of profiles, and numbers that are kept for scopes.
FIRST, SMALL, HELD, KEPT = 64, 8192, 1 << 21, 1 << 20
#: No cost reaches it.
FAR = 1 << 62
#: Bounds are summed in another order than scores.
SLACK = 1e-6
W = fixed.WEIGHTS
READS = {
    "academic": ["academic_bar"],
    "geography": ["country", "region", "city_size", "environment", "teaches_english"],
    "scholarship": ["full_ride_possible", "full_tuition_possible", "scholarship_availability"],
    "tests": ["ielts_need", "sat_policy", "sat_target"],
    "preference": ["research_intensity", "prestige_tier", "size"],
}


def _round(x: np.ndarray) -> np.ndarray:
    return np.floor(x + 0.5)


def _clamp(x, low: float = 0.0, high: float = 100.0) -> np.ndarray:
    """As ``scalar.clamp``: what is missing is taken as the low end."""
    return np.fmin(high, np.fmax(low, x))


def _scale(x, low_in, high_in, low: float, high: float) -> np.ndarray:
    return _clamp(low + (x - low_in) / (high_in - low_in) * (high - low), min(low, high), max(low, high))


def _numbers(column) -> np.ndarray:
    """Doubles, NaN for null."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.float64()).to_numpy()


class Names:
    """Numbers of texts: those of options from 0, others below."""

    def __init__(self, column) -> None:
        self.of = {v: i for i, v in enumerate(sorted({v for v in column.to_pylist() if v is not None}))}

    def options(self, column) -> np.ndarray:
        return np.array([-1 if v is None else self.of[v] for v in column.to_pylist()], np.int64)

    def profiles(self, column) -> np.ndarray:
        return np.array([self.of.get(v, -2) for v in column.to_pylist()], np.int64)


class Catalogue:
    """Options in order of name and id, and per fit the groups that it can't tell apart."""

    def __init__(self, options: pa.Table, last_major: bool = True) -> None:
        """``last_major``: whether a missing major is rated like the last one, as ``element_at`` does where ratings can't be null."""
        self.table, self.n, self.last_major = options.combine_chunks(), options.num_rows, last_major
        col = self.table.column
        total, best = col("total_annual_cost").to_pylist(), col("best_case_net_cost").to_pylist()
        self.total = _numbers(col("total_annual_cost"))
        self.best = np.array([FAR if b is None else b for b in best], np.int64)
        #: an option is within a ceiling that reaches this
        self.need = np.array([-FAR if t is None else min(t, t if b is None else b) for t, b in zip(total, best)], np.int64)
        flag = lambda name: np.array([v is True for v in col(name).to_pylist()], bool)
        self.dependable = flag("aid_dependable")
        self.reliability = np.array([1.0 if v == "competitive" else 0.5 for v in col("aid_certainty").to_pylist()])
        ratings = [r or [] for r in col("major_ratings").to_pylist()]
        self.ratings = np.full((self.n, max(map(len, ratings), default=0)), np.nan)
        for i, r in enumerate(ratings):
            self.ratings[i, :len(r)] = [np.nan if v is None else v for v in r]
        self.names = {c: Names(col(c)) for c in ("country", "region", "city_size", "environment", "size")}
        coded = {c: self.names[c].options(col(c)) for c in self.names}
        self.country = coded["country"]
        self.groups, self.firsts = {}, {}
        for fit, reads in READS.items():
            key = np.zeros(self.n, np.int64)
            for c in reads:
                found: dict = {}
                part = coded[c] + 1 if c in coded else np.array([found.setdefault(v, len(found)) for v in col(c).to_pylist()], np.int64)
                key = np.unique(key * (int(part.max(initial=0)) + 1) + part, return_inverse=True)[1].astype(np.int64)
            _, self.firsts[fit], self.groups[fit] = np.unique(key, return_index=True, return_inverse=True)
        at = lambda fit, values: values[self.firsts[fit]]
        number = lambda fit, c: at(fit, _numbers(col(c)))
        texts = lambda fit, c: at(fit, np.array(col(c).to_pylist(), object))
        self.bar = number("academic", "academic_bar")
        self.place = {c: at("geography", coded[c]) for c in ("country", "region", "city_size", "environment")}
        self.foreign = at("geography", np.array([v is False for v in col("teaches_english").to_pylist()], bool))
        self.ride, self.tuition = at("scholarship", flag("full_ride_possible")), at("scholarship", flag("full_tuition_possible"))
        self.partial = np.array([fixed.PARTIAL_AID_SCORE.get(v, np.nan) for v in texts("scholarship", "scholarship_availability")], np.float64)
        self.band, self.target, self.policy = number("tests", "ielts_need"), number("tests", "sat_target"), texts("tests", "sat_policy")
        self.research, self.prestige, self.size = number("preference", "research_intensity"), number("preference", "prestige_tier"), at("preference", coded["size"])
        self.run = max(1, HELD // max(1, sum(map(len, self.firsts.values()))))
        self.inside = [np.flatnonzero(self.country == c) for c in range(len(self.names["country"].of))]
        self.needs = [np.sort(self.need[i]) for i in self.inside]
        self.all_needs, self.kept, self.kept_size = np.sort(self.need), {}, 0

    # ---- fits per profile and group -----------------------------------------

    def fits(self, p: dict) -> dict[str, np.ndarray]:
        """Scores of a run of profiles: a row each, a column per group of the fit."""
        own = lambda name: p[name][:, None]
        out = {}
        delta = own("gpa_norm") - self.bar
        base = np.where(delta >= 0, _scale(delta, 0.0, 8.0, 78.0, 100.0), _scale(delta, -20.0, 0.0, 15.0, 78.0))
        raw = np.where(own("top"), _clamp(base + 6), base)
        out["academic"] = np.where(np.isnan(own("gpa_norm")), 50.0, _round(raw))

        near, region = p["in_country"][:, self.place["country"]], p["in_region"][:, self.place["region"]]
        base = np.where(own("open"), 78.0, np.where(near, 100.0, np.where(region, 58.0, 20.0)))
        city = np.where(own("any_city"), base, np.where(own("city_size_preference") == self.place["city_size"], _clamp(base + 8), _clamp(base - 5)))
        setting = np.where(own("environment_preference") == self.place["environment"], _clamp(city + 5), city)
        out["geography"] = np.where(own("english_taught_only") & self.foreign, _clamp(setting - 35), setting)

        need = p["aid_need"][:, None]
        ride = np.where(self.ride, 96.0, np.where(self.tuition, 58.0, 14.0))
        tuition = np.where(self.ride | self.tuition, 90.0, 26.0)
        out["scholarship"] = np.where(need == "none", 80.0, np.where(need == "full-ride", ride, np.where(need == "full-tuition", tuition, self.partial)))

        band, sat = own("ielts_band"), own("sat_score")
        english = np.where(band >= self.band + 0.5, 100.0, np.where(band >= self.band, 88.0, _scale(self.band - band, 2.0, 0.0, 10.0, 62.0)))
        english = np.where(np.isnan(band), 45.0, np.where(np.isnan(self.band), 80.0, english))
        taken = np.where(np.isnan(self.target), 80.0, np.where(sat >= self.target, 100.0, _scale(self.target - sat, 250.0, 0.0, 25.0, 92.0)))
        untaken = np.where(self.policy == "required", 30.0, np.where(self.policy == "recommended", 58.0, 85.0))
        out["tests"] = _round((english + np.where(self.policy == "not-used", 92.0, np.where(np.isnan(sat), untaken, taken))) / 2.0)

        research, prestige = own("research"), own("prestige")
        r, s = _clamp(100 - np.abs(research - (self.research - 1) * 25)), _clamp(100 - np.abs(prestige - (self.prestige - 1) * 25))
        size = np.where(own("any_size"), 75.0, np.where(own("size_preference") == self.size, 100.0, 45.0))
        wr, wp = np.fmax(research, 20.0), np.fmax(prestige, 20.0)
        out["preference"] = _round((r * wr + s * wp + size * 40) / (wr + wp + 40))
        return out

    def financial(self, at: np.ndarray, budget: float, ceiling: int | None) -> np.ndarray:
        total, best = self.total[at], self.best[at]
        if ceiling is None:
            top, within, gap = np.nan, np.zeros(len(total), bool), np.zeros(len(total))
        else:
            top, within = float(ceiling), best <= ceiling
            gap = np.where(best == FAR, 0, np.maximum(0, best - ceiling)).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            spare = 1.0 - np.where(total == 0, np.nan, (total - top) / total)
            far = _round(_scale(gap, 0.0, np.fmax(total, 1.0), 34.0, 2.0))
            aided = np.where(self.dependable[at], _round(_clamp(58.0 + spare * 22.0)), _round(_clamp(30.0 + spare * 14.0 + self.reliability[at] * 8.0)))
            paid = 96.0 if budget == top else _round(_scale(total, top, budget, 78.0, 96.0))
        score = np.where(total <= top, paid, np.where(within, aided, far))
        return np.where(np.isnan(total), 50.0, np.where(total <= budget, 100.0, score))

    # ---- profiles ------------------------------------------------------------

    def read(self, batch: pa.RecordBatch) -> dict:
        col = lambda name: batch.column(batch.schema.get_field_index(name))
        listed = lambda name: col(name).to_pylist()
        p: dict = {c: _numbers(col(c)) for c in ("gpa_norm", "ielts_band", "sat_score", "budget_annual_usd")}
        p |= {c: _numbers(col("preferences").field(c)) for c in ("research", "prestige")}
        if col("preferences").null_count:
            gone = np.asarray(col("preferences").is_null())
            p |= {c: np.where(gone, np.nan, p[c]) for c in ("research", "prestige")}
        p["ceiling"], p["major"] = listed("ceiling"), listed("major_index")
        p["top"] = np.array([v in ("top-1", "top-5") for v in listed("class_rank")], bool)
        p["aid_need"] = np.array(listed("aid_need"), object)
        wants, p["countries"] = listed("wants_specific"), listed("preferred_countries")
        p["wants"], p["open"] = np.array([v is True for v in wants], bool), np.array([v is False for v in wants], bool)
        p["english_taught_only"] = np.array([v is True for v in listed("english_taught_only")], bool)
        for pref, of, any_ in (("city_size_preference", "city_size", "any_city"), ("size_preference", "size", "any_size"), ("environment_preference", "environment", None)):
            p[pref], free = self.names[of].profiles(col(pref)), np.array([v == fixed.NO_PREFERENCE for v in listed(pref)], bool)
            if any_:
                p[any_] = free
            else:
                p[pref] = np.where(free, -2, p[pref])
        # a last place for options without a country or region
        for name, lists, key in (("country", p["countries"], "in_country"), ("region", listed("preferred_regions"), "in_region")):
            of = self.names[name].of
            p[key] = np.zeros((len(lists), len(of) + 1), bool)
            for i, some in enumerate(lists):
                p[key][i, [of[c] for c in some or () if c in of]] = True
        #: whether a country is known to lie outside: not where a list or one of its entries is missing
        p["sure"] = np.array([some is not None and None not in some for some in p["countries"]], bool)
        return p

    def scope(self, countries: tuple | None, major: int | None) -> list[tuple[float, np.ndarray, list[np.ndarray]]]:
        """Options of these countries, or all, in portions: the rating of the major, places, and groups per fit. The best ratings come first."""
        key = (countries, major)
        if key not in self.kept:
            at = np.arange(self.n) if countries is None else np.concatenate([self.inside[c] for c in countries] or [np.empty(0, np.int64)])
            column = (-1 if self.last_major else None) if major is None else major - 1
            known = column is not None and -1 <= column < self.ratings.shape[1] and self.ratings.shape[1] and major != 0
            rated = np.nan_to_num(self.ratings[at, column], nan=-1.0) if known else np.full(len(at), -1.0)
            portions = [(rated, at)] if len(at) <= SMALL else [(rated[rated == r], at[rated == r]) for r in np.unique(rated)[::-1]]
            if self.kept_size > KEPT:
                self.kept, self.kept_size = {}, 0
            self.kept_size += len(at)
            self.kept[key] = [(r, i, [self.groups[f][i] for f in READS], self.need[i]) for r, i in portions if len(i)]
        return self.kept[key]

    def exact(self, at: np.ndarray, fits: dict, rating: np.ndarray, budget: float, ceiling: int | None, outside: np.ndarray | None = None) -> np.ndarray:
        """A number per option that orders them by score, name and id. Options without a score come last."""
        scores = {f: fits[f][self.groups[f][at]] for f in READS}
        scores |= {"financial": self.financial(at, budget, ceiling), "major": np.where(rating < 0, np.nan, rating)}
        total = None
        for name, weight in W.items():
            term = scores[name] * weight
            total = term if total is None else total + term
        score = _round(total if outside is None else np.where(outside, total * fixed.OUT_OF_SCOPE_MULTIPLIER, total))
        return (np.where(np.isnan(score), -1, score).astype(np.int64) + 1) * self.n + (self.n - 1 - at)

    def best_by_bound(self, fits: dict, bounds: list, portions: list, keep: int, budget: float, ceiling: int | None, within: bool) -> np.ndarray:
        """The best options of a scope without outsiders, of those within the ceiling or of all."""
        pool = np.empty(0, np.int64)
        for rating, at, groups, need in portions:
            if len(pool) >= keep and int(pool.min()) // self.n - 1 > 100 - W["major"] * (100 - rating.max()) + 0.5 + SLACK:
                break
            bound = rating * W["major"]
            for table, group in zip(bounds, groups):
                bound += table[group]
            if within:
                bound[need > ceiling] = -np.inf
            scored = lambda i: self.exact(at[i], fits, rating[i], budget, ceiling)
            last = int(pool.min()) // self.n - 1 if len(pool) >= keep else -1
            if len(at) > 2 * FIRST:
                first = _top(bound, FIRST)
                if len(first) >= keep:
                    last = max(last, int(np.partition(scored(first), len(first) - keep)[len(first) - keep]) // self.n - 1)
            left = np.flatnonzero(bound >= last - 100 * W["financial"] - 0.5 - SLACK if last >= 0 else bound > -np.inf)
            pool = _most(np.concatenate([pool, scored(left)]), keep)
        return pool

    def find(self, batch: pa.RecordBatch, keep: int, tiers: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the batch and places of their options: the best of each tier that a list can use, or the best of all."""
        p = self.read(batch)
        focused = batch.column(batch.schema.get_field_index("_focused")).to_pylist()
        of = self.names["country"].of
        scopes = [tuple(of[c] for c in some if c in of) if f else None for f, some in zip(focused, p["countries"])]
        order = sorted(range(len(scopes)), key=lambda i: (-1 if p["major"][i] is None else p["major"][i], scopes[i] or ()))
        rows, places = [], []
        per_profile = [k for k, v in p.items() if isinstance(v, np.ndarray)]
        for b in range(0, len(order), self.run):
            some = order[b:b + self.run]
            run = self.fits({k: p[k][some] for k in per_profile})
            capped = {f: np.nan_to_num(run[f]) * W[f] for f in READS}
            for k, i in enumerate(some):
                fits, bounds = {f: run[f][k] for f in READS}, [capped[f][k] for f in READS]
                found = self._listed(p, i, scopes[i], fits, bounds, keep) if tiers else self._best(p, i, fits, bounds, keep)
                at = self.n - 1 - found % self.n
                rows.append(np.full(len(at), i, np.int64))
                places.append(at)
        none = [np.empty(0, np.int64)]
        return np.concatenate(rows or none), np.concatenate(places or none)

    def extremes(self, batch: pa.RecordBatch, highs: list[str], lows: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
        """Rows of the batch, the scores of one option each, and how many options share its first highest and first lowest fit.

        Lowest fits from NO_CONCERN_BOUND on count together. There are at most
        seven fits of either kind. A missing major has no score.
        """
        p = self.read(batch)
        per_profile, names = [k for k, v in p.items() if isinstance(v, np.ndarray)], sorted({*highs, *lows})
        grouped = [f for f in names if f in READS]
        rows, scores, counts = [], {f: [] for f in names}, []
        # the low bits of eight times a score tell fits apart: the first of equal ones is the highest, or the lowest
        whole = lambda x: np.nan_to_num(x, nan=-1.0).astype(np.int16) * np.int16(8)
        rated: dict = {}
        kind = np.empty(self.n, np.int64)
        for b in range(0, batch.num_rows, self.run):
            run = self.fits({k: p[k][b:b + self.run] for k in per_profile})
            tables = {f: whole(run[f]) for f in grouped}
            for i in range(b, min(b + self.run, batch.num_rows)):
                major, budget, ceiling = p["major"][i], p["budget_annual_usd"][i], p["ceiling"][i]
                if major not in rated:
                    known = major is not None and 0 < major <= self.ratings.shape[1]
                    rated[major] = whole(self.ratings[:, major - 1] if known else np.full(self.n, np.nan))

                def scored(f: str, at) -> np.ndarray:
                    if f == "financial":
                        return whole(self.financial(at, budget, ceiling))
                    return rated[major][at] if f == "major" else tables[f][i - b][self.groups[f][at]]

                for first in range(0, self.n, SMALL):
                    at = slice(first, first + SMALL)
                    own = {f: scored(f, at) for f in names}
                    high, low = own[highs[0]] + np.int16(7), own[lows[0]]
                    for n, f in enumerate(highs[1:], 1):
                        high = np.maximum(high, own[f] + np.int16(7 - n))
                    for n, f in enumerate(lows[1:], 1):
                        low = np.minimum(low, own[f] + np.int16(n))
                    kind[at] = (high & 7) * np.int16(8) + np.where(low >> 3 >= fixed.NO_CONCERN_BOUND, np.int16(7), low & 7)
                found, one = np.bincount(kind), np.zeros(64, np.int64)
                one[kind] = np.arange(self.n)
                kinds = np.flatnonzero(found)
                rows.append(np.full(len(kinds), i, np.int64))
                counts.append(found[kinds])
                for f in names:
                    scores[f].append(scored(f, one[kinds]) >> 3)
        joined = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return joined(rows), {f: joined(x) for f, x in scores.items()}, joined(counts)

    def _outside(self, p: dict, i: int, at: np.ndarray) -> np.ndarray | None:
        if not (p["wants"][i] and p["sure"][i]):
            return None
        return (self.country[at] >= 0) & ~p["in_country"][i][self.country[at]]

    def _whole(self, p: dict, i: int, scope: tuple | None, fits: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        at = np.concatenate([x[1] for x in self.scope(scope, p["major"][i])] or [np.empty(0, np.int64)])
        rating = np.concatenate([x[0] for x in self.scope(scope, p["major"][i])] or [np.empty(0)])
        outside = self._outside(p, i, at)
        return at, self.exact(at, fits, rating, p["budget_annual_usd"][i], p["ceiling"][i], outside), outside

    def _listed(self, p: dict, i: int, scope: tuple | None, fits: dict, bounds: list, keep: int) -> np.ndarray:
        ceiling = p["ceiling"][i]
        if ceiling is not None and (scope is not None or not p["wants"][i]):
            needs = [self.all_needs] if scope is None else [self.needs[c] for c in scope]
            # a first tier that is full makes the others useless
            if sum(int(np.searchsorted(x, ceiling, "right")) for x in needs) >= keep:
                return self.best_by_bound(fits, bounds, self.scope(scope, p["major"][i]), keep, p["budget_annual_usd"][i], ceiling, True)
        at, keys, outside = self._whole(p, i, scope, fits)
        dear = self.need[at] > (-FAR if ceiling is None else ceiling)
        outside = np.zeros(len(at), bool) if outside is None else outside
        return np.concatenate([_most(keys[t], keep) for t in (~outside & ~dear, ~outside & dear, outside)])

    def _best(self, p: dict, i: int, fits: dict, bounds: list, keep: int) -> np.ndarray:
        budget, ceiling, major = p["budget_annual_usd"][i], p["ceiling"][i], p["major"][i]
        if not (p["wants"][i] and p["sure"][i]):
            return self.best_by_bound(fits, bounds, self.scope(None, major), keep, budget, ceiling, False)
        own = tuple(np.flatnonzero(p["in_country"][i][:-1]).tolist())
        found = self.best_by_bound(fits, bounds, self.scope(own, major), keep, budget, ceiling, False)
        # nothing outside exceeds the factor's share of a full score; options of unknown country are inside
        if len(found) >= keep and self.country.min(initial=0) >= 0 and int(found.min()) // self.n - 1 > 100 * fixed.OUT_OF_SCOPE_MULTIPLIER + 0.5 + SLACK:
            return found
        return _most(self._whole(p, i, None, fits)[1], keep)


def _top(bound: np.ndarray, some: int) -> np.ndarray:
    """Places of the highest bounds, about so many of them or more."""
    high, step = bound.max(), 2.0
    while True:
        first = np.flatnonzero(bound >= high - step)
        if len(first) >= some or step > 100:
            return first
        step *= 2


def _most(keys: np.ndarray, keep: int) -> np.ndarray:
    return keys if len(keys) <= keep else np.partition(keys, len(keys) - keep)[len(keys) - keep:]


def _search(batches: Iterator[pa.RecordBatch], catalogue: Catalogue, keep: int, tiers: bool, own: list[str]) -> Iterator[pa.RecordBatch]:
    held = catalogue.table.to_batches()
    for batch in batches:
        rows, at = catalogue.find(batch, keep, tiers)
        if len(rows):
            left, right = batch.select(own).take(pa.array(rows)), held[0].take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*left.columns, *right.columns], [*own, *right.schema.names])


def _extremes(batches: Iterator[pa.RecordBatch], catalogue: Catalogue, highs: list[str], lows: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, scores, counts = catalogue.extremes(batch, highs, lows)
        columns = [pa.array(x, pa.int32(), mask=x < 0) for x in scores.values()]
        yield pa.RecordBatch.from_arrays([batch.select(["profile_id"]).column(0).take(pa.array(rows)), pa.array(counts, pa.int64()), *columns], ["profile_id", "_options", *(f"{f}_score" for f in scores)])


def best_and_worst(profiles: DataFrame, options: DataFrame, highs: list[str], lows: list[str], parts: int | None = None) -> DataFrame:
    """Per profile, one option for each first highest fit of ``highs`` and first lowest of ``lows`` that occur together, and how many options of the catalogue it stands for.

    Gives profile_id, _options and the scores of these fits; every option is
    scored with all of them. A missing score is the lowest. Lowest fits from
    NO_CONCERN_BOUND on count together. Repeated profiles have rows each.
    """
    names = sorted({*highs, *lows})
    catalogue = _held(options)
    schema = f"profile_id {profiles.schema['profile_id'].dataType.simpleString()}, _options bigint, " + ", ".join(f"{f}_score int" for f in names)
    spread = profiles.select(*P.PROFILE_SCORING).repartition(*([parts] if parts else []), F.xxhash64("profile_id"))
    return spread.mapInArrow(lambda it: _extremes(it, catalogue.value, highs, lows), schema)


def _held(options: DataFrame):
    """The catalogue, broadcast. Texts are in order of their bytes, nulls first, as lists are ordered."""
    right = options.select(*P.OPTION_SCORING)
    return options.sparkSession.sparkContext.broadcast(Catalogue(right.orderBy("name", "option_id").toArrow(), not right.schema["major_ratings"].dataType.containsNull))


def fits_memory(options: DataFrame) -> bool:
    """Whether the catalogue can be held by the driver and each worker, by its counted rows."""
    return P.measured_bytes(options.select(*P.OPTION_SCORING))[1] <= P.BROADCAST_BYTES


def best_pairs(profiles: DataFrame, options: DataFrame, keep: int, tiers: bool = True, parts: int | None = None) -> DataFrame:
    """Profiles with the options that may be among their best ``keep``, with the scoring columns of both.

    ``profiles`` has PROFILE_SCORING, other columns that pass through, and
    ``_focused``: whether only options of its own countries count. With
    ``tiers``, the best of each tier that a shortlist can use are found, else
    the best by score alone. Rows are searched one by one, so repeated ids,
    null ids and repeated options keep their places; an option without a score
    comes after those with one. An empty side gives no rows.
    """
    own = [c for c in profiles.columns if c != "_focused"]
    right = options.select(*P.OPTION_SCORING)
    catalogue = _held(options)
    schema = StructType([*profiles.select(*own).schema.fields, *right.schema.fields])
    spread = profiles.where(F.col("_focused").isNotNull()).repartition(*([parts] if parts else []), F.xxhash64("profile_id", *[c for c in own if c != "profile_id"]))
    return spread.mapInArrow(lambda it: _search(it, catalogue.value, keep, tiers, own), schema)
