"""Headline and transcript scores."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import clip, col

# Guidance phrases counted in transcripts.
RAISE_PHRASES = (
    "raising guidance", "raised guidance", "increase our guidance", "raising our full-year",
    "above the high end", "raising our outlook", "above our guidance", "raising revenue guidance",
)
LOWER_PHRASES = (
    "lowering guidance", "lowered guidance", "reduce our guidance", "below our guidance",
    "revising guidance lower", "lowering our outlook", "below the low end", "headwinds",
)
MAINTAIN_PHRASES = (
    "reaffirming guidance", "reaffirm", "maintaining guidance", "on track to",
    "comfortable with our guidance", "reiterate", "confident in our",
)


def _automaton(phrases) -> str:
    """Pattern of a letter tree that takes the longest of the phrases at a place."""
    heads: dict[str, list[str]] = {}
    for p in sorted(set(phrases)):
        if p:
            heads.setdefault(p[0], []).append(p[1:])
    # beyond the first letter of all phrases nothing is tried
    branches = [re.escape(h) + _automaton(tails) for h, tails in heads.items()]
    some = branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"
    return "" if not branches else f"(?:{some})?" if "" in phrases else some


def _repeats_itself(phrase: str) -> bool:
    """Can a phrase begin again before it has ended?"""
    return any(phrase.startswith(phrase[i:]) for i in range(1, len(phrase)))


def phrase_counts(text, **classes) -> Column:
    """struct of one count per class: occurrences of each of its phrases, summed; phrases may overlap each other.

    One pass over the text: an automaton of all phrases looks ahead at every place and gives the longest phrase there; a literal table says how
    many phrases of each class begin with it, shorter ones that it starts with included. A phrase that can begin before its last occurrence has ended is looked for by
    itself as well, if it was seen twice, as such occurrences count once.
    """
    every = sorted({p for ps in classes.values() for p in ps})
    if "" in every:
        raise ValueError("an empty phrase")
    found = F.regexp_extract_all(col(text), F.lit(f"(?=({_automaton(every)}))"), F.lit(1))
    begins = {n: F.create_map(*[F.lit(x) for p in every for x in (p, sum(p.startswith(q) for q in ps))]) for n, ps in classes.items()}
    start = F.struct(*[F.lit(0).alias(n) for n in classes])
    own = [p for p in every if _repeats_itself(p)]

    def beginning(hits, p):
        # a lambda of two arguments would be given the place as its second
        return F.size(F.filter(hits, lambda h: h.startswith(p)))

    def counted(hits):
        n = F.aggregate(hits, start, lambda acc, h: F.struct(*[(acc[c] + begins[c][h]).alias(c) for c in classes]))
        seen = {p: beginning(hits, p) for p in own}
        less = {p: F.when(seen[p] > 1, seen[p] - F.regexp_count(col(text), F.lit(re.escape(p).replace("\\ ", " ").replace("\\-", "-")))).otherwise(0) for p in own}
        return F.struct(*[(n[c] - sum((ps.count(p) * less[p] for p in own if p in ps), F.lit(0))).alias(c) for c, ps in classes.items()])

    # one element, so that the hits are found once
    return F.element_at(F.transform(F.array(found), counted), 1)


def tone(n_raise, n_lower, n_maintain) -> Column:
    """0.80 / 0.20 for a clear majority, 0.55 otherwise, missing when nothing was said."""
    up, down, keep = col(n_raise), col(n_lower), col(n_maintain)
    return (
        F.when(up + down + keep == 0, None)
        .when((up > down) & (up > keep), 0.80)
        .when((down > up) & (down > keep), 0.20)
        .when((up + down + keep).isNotNull(), 0.55)
    )


def transcript_tone(text, raises=RAISE_PHRASES, lowers=LOWER_PHRASES, maintains=MAINTAIN_PHRASES) -> Column:
    low = F.lower(col(text))
    # one element, so that the counts are made once and read three times
    said = F.transform(F.array(phrase_counts(low, up=raises, down=lowers, keep=maintains)), lambda n: tone(n["up"], n["down"], n["keep"]))
    return F.when(F.length(low) > 0, F.element_at(said, 1))


# Headline words counted as good and bad news.
BULL_WORDS = (
    "beat", "beats", "exceed", "exceeds", "upgrade", "upgrades", "upgraded", "buy", "outperform", "strong",
    "record", "rally", "surge", "gain", "growth", "bullish", "profit", "revenue", "raise", "raises", "tops",
    "jump", "soar", "boom", "positive", "breakthrough", "approval", "approved", "expands",
)
BEAR_WORDS = (
    "miss", "misses", "downgrade", "downgrades", "sell", "underperform", "concern", "decline", "weak", "loss",
    "cut", "fall", "drop", "recession", "layoff", "lawsuit", "fine", "warning", "risk", "volatile", "below",
    "disappoints", "halt", "investigation", "fraud", "bankruptcy", "default",
)


def headline_score(text, bull=BULL_WORDS, bear=BEAR_WORDS) -> Column:
    """0.5 +- 0.2 per distinct bull/bear word, in [0.1, 0.9]; neutral headlines are missing."""
    words = F.split(F.lower(col(text)), r"\s+")
    up = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in bull])))
    down = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in bear])))
    return F.when(up + down > 0, clip(0.5 + 0.2 * (up - down), 0.10, 0.90))


def buzz(n, full_at: float = 50.0) -> Column:
    x = F.coalesce(col(n).cast("double"), F.lit(0.0))
    return F.least(F.lit(1.0), F.log1p(x) / F.log1p(F.lit(full_at)))


def narrative(parts, n: int = 3, sep: str = " · ") -> Column:
    """The first n present parts in evidence order, joined; missing parts are skipped."""
    return F.array_join(F.slice(F.array_compact(F.array(*parts)), 1, n), sep)


# Texts, limits and signs of the evidence line.
NO_EVIDENCE, DOUBLE_SIGNAL, LINE_CHARS, NAME_CHARS = "no primary catalyst detected", " ⚠double-signal", 80, 12
EPS_DAYS, MOMENTUM_FROM, MOMENTUM_RISK, FEW_ANALYSTS, LOW_REVISION, LOW_QUALITY = 90, 0.05, -0.10, 5, 0.35, 0.30


def _tenths(x) -> Column:
    """A number that is not negative, with one digit behind the point."""
    n = F.round(col(x) * 10).cast("long")
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def thousands(usd) -> Column:
    """$12.3k, from $100k on without the digit."""
    u = col(usd)
    whole = F.concat(F.round(u / 1000).cast("long").cast("string"), F.lit("k"))
    return F.concat(F.lit("$"), F.when(u >= 100_000, whole).otherwise(F.concat(_tenths(u / 1000), F.lit("k"))))


def evidence_line(usd, tier, surprise, surprise_days, action, firm, action_days, purchases, member, relative, absolute, intl, analysts, correlated, revision, quality) -> Column:
    """What speaks for a name, in at most LINE_CHARS: the first three of insider buys, earnings, rating change, congress and momentum, else the analysts' revision.

    Missing inputs leave their part out. A market without a benchmark-relative momentum shows the absolute one and says so. Warnings follow: doubled
    signals, and up to two of falling momentum, weak revisions and weak accounts.
    """
    name = lambda x: F.left(col(x), F.lit(NAME_CHARS))
    some = lambda x: F.coalesce(col(x).cast("double"), F.lit(0.0))
    rank = F.when((F.trim(col(tier)) != "") & (F.lower(F.trim(col(tier))) != "none"), F.concat(F.lit(" ["), F.trim(col(tier)), F.lit("]")))
    insider = F.when(some(usd) > 0, F.concat(F.lit("Insider "), thousands(usd), F.coalesce(rank, F.lit(""))))
    pct, days = _tenths(F.abs(col(surprise)) * 100), F.coalesce(col(surprise_days), F.lit(0)).cast("long")
    eps = F.when(days <= EPS_DAYS, F.when(col(surprise) < 0, F.concat(F.lit("EPS miss "), pct, F.lit("%"))).otherwise(F.concat(F.lit("EPS +"), pct, F.lit("% · "), days.cast("string"), F.lit("d ago"))))
    by = F.when(col(firm) != "", F.concat(F.lit(" "), name(firm)))
    rated = F.when(col(action).isin("upgrade", "downgrade"), F.concat(F.upper(col(action)), F.coalesce(by, F.lit("")), F.lit(" "), F.coalesce(col(action_days), F.lit(0)).cast("long").cast("string"), F.lit("d")))
    congress = F.when(some(purchases) > 0, F.concat(col(purchases).cast("long").cast("string"), F.lit("x congress buy · "), F.coalesce(name(member), F.lit("members"))))
    alone = col(intl) & (some(relative) == 0)
    rel = F.when(alone, some(absolute)).otherwise(some(relative))
    moved = F.concat(F.when(rel >= 0, "+").otherwise("-"), _tenths(F.abs(rel) * 100), F.lit("% "), F.when(alone, "12-1m abs").otherwise("vs SPY 12m"))
    momentum = F.when(F.abs(rel) > MOMENTUM_FROM, moved)
    first = F.nullif(narrative([insider, eps, rated, congress, momentum]), F.lit(""))
    fallback = F.when(some(analysts) >= FEW_ANALYSTS, F.concat(F.lit("analyst revision ("), col(analysts).cast("long").cast("string"), F.lit(" analysts)")))
    line = F.left(F.coalesce(first, fallback, F.lit(NO_EVIDENCE)), F.lit(LINE_CHARS))
    line = F.when(F.coalesce(col(correlated), F.lit(False)), F.concat(F.left(line, F.lit(LINE_CHARS - len(DOUBLE_SIGNAL))), F.lit(DOUBLE_SIGNAL))).otherwise(line)
    weak = lambda x, below: (some(x) > 0) & (some(x) < below)
    flags = narrative([
        F.when(rel < MOMENTUM_RISK, F.concat(F.lit("⚠ mom "), F.round(rel * 100).cast("long").cast("string"), F.lit("%"))),
        F.when(weak(revision, LOW_REVISION), "⚠ rev↓"), F.when(weak(quality, LOW_QUALITY), "⚠ F-Score↓"),
    ], 2, " ")
    return F.when(flags != "", F.left(F.concat(line, F.lit(" | "), flags), F.lit(LINE_CHARS))).otherwise(line)
