"""Personal data by weak supervision: labelers vote on candidate spans, their reliabilities are estimated, a span classifier decides.

Everything on the rows is built from SQL expressions. The driver sees one
bounded table: how often each combination of votes and features occurs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxframe.llm.text import staged

KINDS = ("email", "ip", "card", "phone")

# Matches of the base patterns, written so that Java's matcher neither recurses
# nor starts anew inside a run that has already failed: possessive loops, and a
# match begins where its run begins or where the last match ended (\G).
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Only runs of 14 to 19 digits; others fail in any case.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Shapes beyond the base, which the classifier may add.
EXTRA = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({] ?(?:at|AT) ?[\])}] ?[A-Za-z0-9-]++(?: ?[\[({] ?(?:dot|DOT) ?[\])}] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12}+(?![ -]?[0-9])",
    "phone": r"(?<![0-9+.)(-])(?<![0-9] )(?:00[1-9][0-9]{0,2}[ .-]?)?\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
#: What a text must contain for a pattern to be tried.
NEEDS = {"email": "instr(text, '@') > 0", "ip": r"text RLIKE '[0-9][.][0-9]'", "card": "text RLIKE '[0-9]{2}|[0-9][ -][0-9]'", "phone": "instr(text, '+') > 0"}
NEEDS_EXTRA = {"email": r"text RLIKE '[\\[({] ?(?:at|AT) ?[\\])}]'", "ip": "text RLIKE '[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:'",
               "card": "text RLIKE '[0-9]{2}|[0-9][ -][0-9]'", "phone": "text RLIKE '[ .-][0-9]{3}[ .-][0-9]{4}'"}
DIGITS = "regexp_replace(value, '[^0-9]', '')"
VALID = {
    "email": "true", "ip": f"value RLIKE '^{OCTET}[.]{OCTET}[.]{OCTET}[.]{OCTET}$'", "card": f"luhn_check({DIGITS})",
    "phone": f"length({DIGITS}) BETWEEN 10 AND 15",
}
# Gazetteers: endings of domains, addresses of no person, card issuers, codes that are no area.
GAZETTEER = {
    "email": "CASE WHEN lower(value) RLIKE '(?:[.]|dot[])} ]+)(?:com|org|net|edu|gov|info|biz|io|de|fr|es|uk|eu|it|nl|ch|at|us|ca|au|jp|br|in)$' THEN 1 ELSE 0 END",
    "ip": "CASE WHEN value RLIKE '^0*(?:0|127|255|22[4-9]|23[0-9])[.]' THEN -1 ELSE 1 END",
    "card": f"CASE WHEN {DIGITS} RLIKE '^(?:3[47]|4|5[1-5]|2[2-7]|6[0245])' THEN 1 ELSE -1 END",
    "phone": f"CASE WHEN {DIGITS} RLIKE '^(?:00)?[1-9]11' THEN -1 ELSE 1 END",
}
# Context: the words in front.
CUES = {"email": "mail|contact|write|reach|correo|courriel", "ip": "\\\\bip\\\\b|host|server|address|login|client", "card": "card|visa|credit|pay|karte|carte|tarjeta|account",
        "phone": "phone|tel|call|mobile|fax|contact|numero|nummer"}
AGAINST = {"email": "git|ssh|example", "ip": "version|\\\\bv$|section|release|build", "card": "isbn|order|serial|token|hash|id:? ?$", "phone": "isbn|order|serial|version|id:? ?$"}
CONTEXT = 24

CANDIDATE = "kind, start, `end`, base, regex, gazetteer, context, size, separated, glued"
FEATURES = ("regex", "gazetteer", "context", "size", "separated", "glued")
LEVELS = {"regex": 3, "gazetteer": 3, "context": 3, "size": 4, "separated": 2, "glued": 2}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _matches(pattern: str, needs: str) -> str:
    """Array of (value, start, end) of all matches, in code points from 0.

    Texts between matches and the matches themselves are measured; running sums
    over them go by chunks of 256, so many matches cost little more than few.
    """
    p = _quoted(pattern)
    step = "char_length(element_at(gaps, i + 1)) + char_length(element_at(found, i + 1))"
    before = "element_at(bases, CAST(i div 256 AS int) + 1) + aggregate(slice(steps, CAST(i div 256 AS int) * 256 + 1, i % 256), 0, (s, x) -> s + x) + char_length(element_at(gaps, i + 1))"
    spans = _let("bases", "transform(sequence(0, CAST(size(found) div 256 AS int)), j -> aggregate(slice(steps, 1, j * 256), 0, (s, x) -> s + x))",
                 f"transform(sequence(0, size(found) - 1), i -> {_let('at', before, 'named_struct(' + repr('value') + ', element_at(found, i + 1), ' + repr('start') + ', at, ' + repr('end') + ', at + char_length(element_at(found, i + 1)))')})")
    body = _let("steps", f"transform(sequence(0, size(found) - 1), i -> {step})", spans)
    empty = "CAST(array() AS array<struct<value: string, start: int, end: int>>)"
    return _let("found", f"CASE WHEN {needs} THEN regexp_extract_all(text, {p}, 0) ELSE array() END",
                f"CASE WHEN size(found) = 0 THEN {empty} ELSE {_let('gaps', f'split(text, {p}, -1)', body)} END")


def _candidate(kind: str, base: bool) -> str:
    """Struct of a match m with its votes and features."""
    of = lambda e: e.replace("value", "m.value")
    valid = of(VALID[kind]) if base or kind == "card" else "true"
    before = f"lower(substr(text, greatest(m.start - {CONTEXT}, 0) + 1, least(m.start, {CONTEXT})))"
    beside = "substr(text, m.start, 1)", "substr(text, m.`end` + 1, 1)"
    glued = f"CASE WHEN (m.start > 0 AND {beside[0]} RLIKE '[A-Za-z0-9]') OR {beside[1]} RLIKE '[A-Za-z0-9]' THEN 1 ELSE 0 END"
    length = "m.`end` - m.start"
    return (
        f"named_struct('kind', {KINDS.index(kind)}, 'start', m.start, 'end', m.`end`, 'base', {valid if base else 'false'}, "
        f"'regex', CASE WHEN NOT ({valid}) THEN 0 WHEN {'true' if base else 'false'} THEN 2 ELSE 1 END, 'gazetteer', 1 + {of(GAZETTEER[kind])}, "
        f"'context', CASE WHEN {before} RLIKE '{CUES[kind]}' THEN 2 WHEN {before} RLIKE '{AGAINST[kind]}' THEN 0 ELSE 1 END, "
        f"'size', CASE WHEN {length} < 12 THEN 0 WHEN {length} < 18 THEN 1 WHEN {length} < 30 THEN 2 ELSE 3 END, "
        f"'separated', CASE WHEN m.value RLIKE '[ ()\\\\[\\\\]{{}}-]' THEN 1 ELSE 0 END, 'glued', {glued})"
    )


def candidates() -> Column:
    """All candidate spans of the column ``text``: base matches, then other shapes that overlap no valid base match."""
    base = "concat(" + ", ".join(f"transform({_matches(BASE[k], NEEDS[k])}, m -> {_candidate(k, True)})" for k in KINDS) + ")"
    extra = "concat(" + ", ".join(f"transform({_matches(EXTRA[k], NEEDS_EXTRA[k])}, m -> {_candidate(k, False)})" for k in KINDS) + ")"
    apart = "filter(others, o -> NOT exists(sure, b -> b.base AND b.start < o.`end` AND o.start < b.`end`))"
    return F.expr(_let("sure", base, f"concat(sure, {_let('others', extra, apart)})"))


@dataclass
class SpanModel:
    """Per kind: weights of the features' levels and a constant."""

    constant: dict[int, float] = field(default_factory=dict)
    weights: dict[int, dict[str, list[float]]] = field(default_factory=dict)

    def accepts(self) -> str:
        """SQL condition on a candidate ``c``. Kinds without candidates add nothing."""
        cases = []
        for kind, w in self.weights.items():
            terms = " + ".join(f"element_at(array({', '.join(f'{x:.9e}D' for x in w[f])}), c.{f} + 1)" for f in FEATURES)
            cases.append(f"WHEN c.kind = {kind} THEN {self.constant[kind]:.9e}D + {terms} >= 0.0D")
        return f"CASE {' '.join(cases)} ELSE false END" if cases else "false"


def estimate(votes: np.ndarray, counts: np.ndarray, steps: int = 60) -> np.ndarray:
    """Probability that each combination of votes (0 against, 1 none, 2 for) marks personal data.

    Expectation-maximisation for labelers that err independently: a prior and,
    per labeler and truth, the chances of its votes. It starts from labelers that
    are right more often than wrong; one count is added to every cell.
    """
    chance = np.array([[[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]]] * votes.shape[1])  # labeler, truth, vote
    prior, p = 0.5, np.zeros(len(votes))
    for _ in range(steps):
        like = np.array([np.prod([chance[j, y, votes[:, j]] for j in range(votes.shape[1])], axis=0) for y in (0, 1)])
        p = prior * like[1] / (prior * like[1] + (1 - prior) * like[0])
        prior = float((counts @ p + 1) / (counts.sum() + 2))
        for y, q in ((0, 1 - p), (1, p)):
            for j in range(votes.shape[1]):
                cell = np.bincount(votes[:, j], weights=counts * q, minlength=3) + 1
                chance[j, y] = cell / cell.sum()
    return p


def train(table: list[tuple[int, ...]]) -> SpanModel:
    """Classifier from rows (kind, the features' levels, count): logistic regression on the estimated probabilities."""
    model = SpanModel()
    for kind in sorted({r[0] for r in table}):
        rows = np.array([r[1:] for r in table if r[0] == kind], dtype=np.int64)
        x, counts = rows[:, :-1], rows[:, -1].astype(np.float64)
        target = estimate(x[:, :3], counts)
        design = np.hstack([np.eye(LEVELS[f])[x[:, i]] for i, f in enumerate(FEATURES)] + [np.ones((len(x), 1))])
        share, w = np.sqrt(counts) / np.sqrt(counts).sum(), np.zeros(design.shape[1])
        for _ in range(3000):
            p = 1 / (1 + np.exp(-design @ w))
            w -= 1.0 * (design.T @ (share * (p - target)) + 1e-4 * w)
        ends = np.cumsum([LEVELS[f] for f in FEATURES])
        model.weights[kind] = {f: w[e - LEVELS[f] : e].tolist() for f, e in zip(FEATURES, ends)}
        model.constant[kind] = float(w[-1])
    return model


def _with_candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("text")).select(*keep, candidates().alias("found"))


def fit_spans(found: DataFrame) -> SpanModel:
    """Reliabilities and classifier from a table with a column ``found``; only counts of feature combinations (1,728 at most) are collected."""
    columns = ["kind", *FEATURES]
    table = found.select(F.explode("found").alias("c")).select(*[f"c.{c}" for c in columns]).groupBy(*columns).count().orderBy(*columns)
    return train([tuple(r) for r in table.collect()])


def spans(model: SpanModel) -> Column:
    """Final spans (kind, start, end, base) by start, then kind: all base ones and what the classifier adds."""
    kept = f"transform(filter(found, c -> c.base OR (c.regex > 0 AND {model.accepts()})), c -> named_struct('start', c.start, 'kind', c.kind, 'end', c.`end`, 'base', c.base))"
    return F.expr(f"array_sort({kept})")


def pii_spans(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, spans) for documents (key, text): every row's personal data, places in code points, end exclusive.

    A NULL or empty text has an empty array. Rows are judged one by one, so NULL
    keys and repeated rows stay; other columns are not read. An empty table gives
    an empty result. The text is read once: candidates are written with their key
    and the classifier reads them there.
    """
    found = staged(_with_candidates(docs, [key]))
    return found.select(key, spans(fit_spans(found)).alias("spans"))


def joined(of: str = "spans") -> Column:
    """Digest of an array of spans: kind:start:end, comma-joined."""
    names = "array(" + ", ".join(repr(k) for k in KINDS) + ")"
    return F.expr(f"array_join(transform({of}, s -> concat_ws(':', element_at({names}, s.kind + 1), s.start, s.`end`)), ',')")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by <EMAIL>, <IP>, <CARD> or <PHONE>; n_chars, where present, follows.

    Of overlapping spans the first one counts, and its neighbours only from its
    end on. Texts without personal data and NULL texts stay as they are; columns
    and rows stay. The text is searched twice: to learn, and to replace.
    """
    model = fit_spans(docs.select(F.coalesce("text", F.lit("")).alias("text")).select(candidates().alias("found")))
    tags = "array(" + ", ".join(f"'<{k.upper()}>'" for k in KINDS) + ")"
    # (text so far, end of the last span): what lies between spans is copied, spans become tags.
    step = (f"(a, s) -> CASE WHEN s.`end` <= a.at THEN a ELSE named_struct('parts', array_append(a.parts, concat(substr(text, a.at + 1, greatest(s.start - a.at, 0)), "
            f"CASE WHEN s.start >= a.at THEN element_at({tags}, s.kind + 1) ELSE '' END)), 'at', s.`end`) END")
    clean = F.expr(f"aggregate(spans, named_struct('parts', CAST(array() AS array<string>), 'at', 0), {step}, a -> concat(array_join(a.parts, ''), substr(text, a.at + 1)))")
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).alias("text")).select("row", "text", candidates().alias("found"))
    marked = marked.select("row", "text", spans(model).alias("spans"))
    cleaned = marked.select("row", "spans", F.when(F.size("spans") > 0, clean).otherwise(F.col("row.text")).alias("text"))
    length = F.when(F.size("spans") > 0, F.char_length("text"))
    return cleaned.select(*[
        F.col("text") if c == "text" else F.coalesce(length, F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ])
