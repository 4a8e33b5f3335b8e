"""Text functions as stages: cleaning, enrichment, and the builders of titles, names, descriptions and steps."""

from __future__ import annotations

import re
from functools import cache

from . import constants as C
from .dialect import Spark, Stage

WHITE = "[\\s\u00a0\ufeff\u2028\u2029]"


def spaces(d: Spark, x: str) -> str:
    """All white space as ASCII white space, null as empty."""
    return d.replace(f"coalesce({x}, '')", "[\u00a0\ufeff\u2028\u2029]", " ")


def trim(d: Spark, x: str) -> str:
    return d.replace(x, r"^\s+|\s+$", "")


def squeeze(d: Spark, x: str) -> str:
    return trim(d, d.replace(x, r"\s{2,}", " "))


def scrub(d: Spark, x: str) -> str:
    """Without web addresses and the shells they leave."""
    for p in C.WEB:
        x = d.replace(x, p)
    return trim(d, d.replace(d.replace(x, r"\s{2,}", " "), r"\s+([.,;:!?])", r"\1"))


def contains_url(d: Spark, x: str) -> str:
    return "(" + " OR ".join(d.matches(x, p) for p in C.WEB) + ")"


def words(d: Spark, x: str) -> str:
    return d.keep(d.split(x, r"\s+"), lambda e: f"{e} <> ''")


def word_count(d: Spark, x: str) -> str:
    return d.size(words(d, x))


def cap(d: Spark, x: str) -> str:
    return d.concat(f"upper(substr({x}, 1, 1))", f"substr({x}, 2)")


def proper(d: Spark, w: str, other: str) -> str:
    """The fixed spelling of a product noun, else the other expression."""
    return "CASE " + " ".join(f"WHEN lower({w}) = {d.lit(k)} THEN {d.lit(v)}" for k, v in C.PROPER.items()) + f" ELSE {other} END"


def titled(d: Spark, ws: str, keep_inner: bool) -> str:
    rest = lambda e: cap(d, e) if keep_inner else cap(d, f"lower({e})")
    return d.join(d.each_numbered(ws, lambda e, i: proper(d, e, f"CASE WHEN {d.among(f'lower({e})', C.MINOR)} AND {i} <> 1 THEN lower({e}) ELSE {rest(e)} END")))


# ------------------------------------------------------------------ enrichment


def canonical(source: str, out: str = "canonical_key") -> list[Stage]:
    """Sorted distinct tokens of a text after its wordings, models and noise are made alike."""

    def keyed(d: Spark) -> str:
        x = f"lower({out}_scrubbed)"
        for p, to in C.WORDINGS:
            x = d.replace(x, p, to)
        x = d.replace(d.replace(x, C.MODELS, " "), C.NOISE, " ")
        return d.replace(x, r"[^a-z0-9\s]", " ")

    return [
        (f"{out}_scrubbed", lambda d: scrub(d, spaces(d, source))),
        (f"{out}_plain", keyed),
        (out, lambda d: d.join(d.sorted(d.distinct(d.keep(d.split(f"{out}_plain", r"\s+"), lambda e: f"length({e}) > 2"))))),
    ]


@cache
def _canonical_patterns() -> tuple:
    """Patterns as the stages mean them: classes, edges and case of ASCII, '$' the very end, '.' no line end of any kind."""
    own = lambda p: re.compile(p.replace(".*?", "[^\\n\\r\\u0085\\u2028\\u2029]*?"), re.ASCII)
    pieces = lambda p: [x for x in re.split(r"\(\?i\)|\\b|\(\?:[^()]*\)\??|[^()]\?|[()?|]", p) if re.fullmatch(r"[a-z' ]+", x)]
    alternatives = lambda p: re.search(r"\(\?:[^()]*\(", p)
    wordings = [(max(pieces(p[: alternatives(p).start()] if alternatives(p) else p), key=len, default=""), own(p), to) for p, to in C.WORDINGS]
    return own("[\u00a0\ufeff\u2028\u2029]"), [own(p) for p in C.WEB], re.compile(r"[\[(<]|://|\.[^ \t\n\x0b\f\r]"), own(r"\s{2,}"), own(r"\s+([.,;:!?])"), wordings, own(C.MODELS), own(C.NOISE), own(r"[^a-z0-9\s]")


def canonical_of(text: str | None) -> str:
    """The key that canonical() gives a text, for Arrow batches: its patterns take a tenth of the time here, where most are passed by for lack of a fixed part."""
    spaces_, web, may_be_web, runs, before_stop, wordings, models, noise, other = _canonical_patterns()
    x = spaces_.sub(" ", text or "")
    if may_be_web.search(x):
        for p in web:
            x = p.sub("", x)
    x = before_stop.sub(r"\1", runs.sub(" ", x)).strip(" \t\n\x0b\f\r").lower()
    for part, p, to in wordings:
        if part in x:
            x = p.sub(to, x)
    return " ".join(sorted({e for e in other.sub(" ", noise.sub(" ", models.sub(" ", x))).split() if len(e) > 2}))


def content_tokens(key: str, out: str = "content_tokens") -> list[Stage]:
    return [(out, lambda d: d.keep(d.split(key, " "), lambda e: f"{e} <> '' AND NOT {d.among(e, C.GENERIC)}"))]


def symptom(source: str, out: str = "symptom") -> list[Stage]:
    """What is left of a complaint without its number, quotes and device."""

    def core(d: Spark) -> str:
        x = d.replace(source, r"^\s*\d+[.)]\s*")
        x = d.replace(x, r"^[\"']|[\"']$")
        x = d.replace(x, C.OWN_DEVICE)
        x = d.replace(x, r"(?i)^\s*(?:i\s+(?:have|am having|'m having)\s+)")
        return squeeze(d, d.replace(x, r"[.!?]+$"))

    return [
        (f"{out}_core", core),
        (f"{out}_cut", lambda d: f"CASE WHEN length({out}_core) > 110 THEN {d.replace(f'substr({out}_core, 1, 110)', r'\s+\S*$')} ELSE {out}_core END"),
        (out, lambda d: d.concat(f"lower(substr({out}_cut, 1, 1))", f"substr({out}_cut, 2)")),
    ]


def keywords(source: str, out: str = "keywords") -> list[Stage]:
    plain = lambda d: d.split(d.replace(f"lower({source})", r"[^a-z0-9\s]", " "), r"\s+")
    return [
        (f"{out}_words", lambda d: d.keep(plain(d), lambda e: f"length({e}) > 2 AND NOT {d.among(e, C.KEYWORD_STOPS)}")),
        (out, lambda d: d.join(d.first(d.distinct(f"{out}_words"), 6))),
    ]


def typo(source: str, out: str = "typo") -> list[Stage]:
    """The first known word misspelt everywhere, else the first space between two words of three letters dropped."""
    return [
        (out, lambda d: "CASE " + " ".join(f"WHEN {d.matches(source, '(?i)' + w)} THEN {d.replace(source, '(?i)' + w, bad)}" for w, bad in C.TYPOS)
            + f" ELSE {d.replace(source, r'(?s)^(.*?)\b(\w{3,})\s(\w{3,})\b(.*)$', r'\1\2\3\4')} END"),
    ]


def variations(source: str, out: str = "variations") -> list[Stage]:
    """8 to 10 distinct paraphrases of a complaint; none of a blank one."""
    s, base = f"{out}_symptom", f"{out}_base"
    verb = lambda d: d.matches(s, C.OPENS_WITH_VERB)

    def templates(d: Spark) -> str:
        before = lambda none: f"CASE WHEN {verb(d)} THEN {s} ELSE {d.concat(d.lit(none), s)} END" if none else s
        said = [d.concat(d.lit(start), before(none), d.lit(end)) for start, none, end in C.PARAPHRASES]
        own = f"CASE WHEN {d.matches(base, r'\.$')} THEN {base} ELSE {d.concat(base, d.lit('.'))} END"
        return d.array(own, *said[:4], f"{out}_keywords", *said[4:6], f"{out}_typo", *said[6:])

    def spares(d: Spark) -> str:
        return d.array(*(d.concat(d.lit(start), s, d.lit(end)) if start else d.concat(cap(d, s), d.lit(end)) for start, end in C.SPARES))

    low, high = C.VARIATIONS
    tidy = lambda d, xs: d.keep(d.each(xs, lambda e: squeeze(d, e)), lambda e: f"length({e}) >= 8")
    return [
        (base, lambda d: squeeze(d, scrub(d, spaces(d, source)))),
        *symptom(base, s),
        *keywords(base, f"{out}_keywords"),
        *typo(base, f"{out}_typo"),
        (f"{out}_kept", lambda d: tidy(d, templates(d))),
        (f"{out}_ten", lambda d: d.first(d.distinct_folded(f"{out}_kept"), high)),
        (f"{out}_spare", lambda d: tidy(d, spares(d))),
        (f"{out}_more", lambda d: d.distinct_folded(f"{out}_spare")),
        (f"{out}_new", lambda d: d.lacking(f"{out}_more", f"{out}_ten")),
        (out, lambda d: f"CASE WHEN {base} = '' THEN {d.first(f'{out}_ten', 0)} ELSE " + d.concat_arrays(f"{out}_ten", d.first(f"{out}_new", f"CASE WHEN {d.size(f'{out}_ten')} < {low} THEN {low} - {d.size(f'{out}_ten')} ELSE 0 END")) + " END"),
    ]


# ------------------------------------------------------------------ builders


def title(source: str, out: str = "title_built") -> list[Stage]:
    bare = lambda d, e: d.replace(f"lower({e})", "['’]")
    return [
        (f"{out}_words", lambda d: d.keep(d.each(words(d, scrub(d, spaces(d, source))), lambda e: d.replace(e, "[^A-Za-z0-9'-]")), lambda e: f"{e} <> '' AND NOT {d.among(bare(d, e), C.STOPWORDS)} AND NOT {d.matches(e, C.MODEL_CODE)}")),
        (f"{out}_kept", lambda d: f"CASE WHEN {d.size(f'{out}_words')} = 0 THEN {d.array(d.lit('Device'), d.lit('issue'))} WHEN {d.size(f'{out}_words')} = 1 THEN {d.array(d.at(f'{out}_words', 1), d.lit('issue'))} ELSE {d.first(f'{out}_words', 3)} END"),
        (out, lambda d: d.join(d.each_numbered(f"{out}_kept", lambda e, i: proper(d, e, f"CASE WHEN {i} = 1 THEN {cap(d, e)} ELSE lower({e}) END")))),
    ]


def action_name(source: str, out: str = "action_name") -> list[Stage]:
    def cleaned(d: Spark) -> str:
        x = d.replace(scrub(d, spaces(d, source)), r"(?i)^\s*(?:###?\s*)?(?:step\s*\d+\s*[:.\-]\s*)")
        return trim(d, d.replace(d.replace(x, r"^\d+[.)]\s*"), r"[.:;]+$"))

    return [
        (f"{out}_words", lambda d: d.first(words(d, cleaned(d)), 6)),
        (out, lambda d: f"CASE WHEN {d.size(f'{out}_words')} = 0 THEN 'Review Device Settings' ELSE {titled(d, f'{out}_words', True)} END"),
    ]


def description(source: str, out: str = "description_built") -> list[Stage]:
    """'It will' and three to five words of a benefit that open with a verb."""
    b, c, v, s = f"{out}_body", f"{out}_chosen", f"{out}_verb", f"{out}_sized"
    lead = lambda d: f"lower({d.at(c, 1)})"

    def led(d: Spark) -> str:
        stem = f"substr({lead(d)}, 1, length({lead(d)}) - 3)"
        gerund = f"{lead(d)} LIKE '%ing' AND length({lead(d)}) > 5"
        with_first = lambda x: d.concat_arrays(d.array(x), d.since(c, 2))
        return (
            f"CASE WHEN {d.size(c)} = 0 OR {d.among(lead(d), C.LEAD_VERBS)} THEN {c} WHEN {gerund} AND {d.among(stem, C.LEAD_VERBS)} THEN {with_first(stem)} "
            f"WHEN {gerund} AND {d.among(d.concat(stem, d.lit('e')), C.LEAD_VERBS)} THEN {with_first(d.concat(stem, d.lit('e')))} ELSE {d.concat_arrays(d.array(d.lit('check')), c)} END"
        )

    return [
        (b, lambda d: d.keep(d.each(words(d, scrub(d, spaces(d, source))), lambda e: d.replace(e, "[^A-Za-z0-9'-]")), lambda e: f"{e} <> '' AND NOT {d.among(f'lower({e})', ('it', 'will', 'your'))}")),
        (c, lambda d: f"CASE WHEN {d.size(b)} <= 5 THEN {b} ELSE {d.keep(b, lambda e: f'NOT {d.among(f"lower({e})", C.STOPWORDS)}')} END"),
        (v, led),
        (s, lambda d: f"CASE WHEN {d.size(v)} = 0 THEN {d.array(d.lit('restore'), d.lit('normal'), d.lit('behaviour'))} ELSE {d.first(v, 5)} END"),
        (f"{out}_filled", lambda d: (
            f"CASE WHEN {d.size(s)} = 2 AND NOT {d.among(f'lower({d.at(s, 2)})', C.FUNCTION_WORDS)} THEN {d.array(d.at(s, 1), d.lit('the'), d.at(s, 2))} WHEN {d.size(s)} = 2 THEN {d.array(d.at(s, 1), d.at(s, 2), d.lit('device'))} "
            f"WHEN {d.size(s)} = 1 THEN {d.array(d.at(s, 1), d.lit('the'), d.lit('device'))} ELSE {s} END")),
        (out, lambda d: d.concat(d.lit("It will "), d.join(d.each(f"{out}_filled", lambda e: proper(d, e, f"lower({e})"))))),
    ]


def topic(source: str, out: str = "topic") -> list[Stage]:
    def cut(d: Spark) -> str:
        x = d.replace(spaces(d, source), r"(?i)\bon (?:a |your )?(?:smartphone|phone|tablet|device)s?\b[^\n\r]*$")
        x = d.replace(x, r"(?i)\bfor (?:a |your )?(?:smartphone|phone|tablet|device)s?\b[^\n\r]*$")
        return trim(d, d.replace(x, r"[(){}\[\]]", " "))

    ok = lambda d, e: f"{e} <> '' AND NOT {d.among(d.replace(f'lower({e})', '[' + chr(39) + '’]'), C.STOPWORDS)} AND NOT {d.among(f'lower({e})', C.BRANDS)} AND NOT {d.matches(e, C.MODEL_CODE)}"
    return [
        (f"{out}_words", lambda d: d.first(d.keep(d.each(words(d, cut(d)), lambda e: d.replace(e, "[^A-Za-z0-9'-]")), lambda e: ok(d, e)), 3)),
        (out, lambda d: f"CASE WHEN {d.size(f'{out}_words')} = 0 THEN 'Device' ELSE {d.join(f'{out}_words')} END"),
    ]


def goal(source: str, out: str = "goal_built") -> list[Stage]:
    return [
        (f"{out}_titled", lambda d: titled(d, words(d, scrub(d, spaces(d, source))), False)),
        (out, lambda d: d.concat(d.lit("Follow these steps to perform this "), trim(d, d.replace(f"{out}_titled", r"[.,;:]+$")), d.lit(" Troubleshooting"))),
    ]


def benefit(heading: str, body: str, out: str = "benefit") -> list[Stage]:
    """The heading as a phrase; of a heading of one word the start of the first line with more than three. body: array of lines."""
    h = f"{out}_heading"
    longer = lambda d: d.keep(body, lambda e: f"{d.size(d.split(e, r'\s+'))} > 3")
    return [
        (h, lambda d: squeeze(d, d.replace(d.replace(heading, r"(?i)^\s*(?:step\s*\d+\s*[:.\-]\s*|\d+[.)]\s*)"), r"[^A-Za-z0-9'\s-]", " "))),
        (f"{out}_line", lambda d: d.at(longer(d), 1)),
        (out, lambda d: f"CASE WHEN {word_count(d, h)} >= 2 THEN {d.join(words(d, h))} WHEN {out}_line IS NOT NULL THEN {d.join(d.first(d.split(f'{out}_line', r'\s+'), 6))} WHEN {h} <> '' THEN {h} ELSE 'resolve the issue' END"),
    ]


def step(source: str, out: str = "step") -> list[Stage]:
    """A step without bullets and number, closed and capitalised; empty where nothing is left."""
    return [
        (f"{out}_scrubbed", lambda d: scrub(d, source)),
        (f"{out}_bare", lambda d: squeeze(d, d.replace(d.replace(f"{out}_scrubbed", r"^[\s\-*•·]+"), r"^\d+[.)]\s*"))),
        (f"{out}_closed", lambda d: f"CASE WHEN {out}_bare = '' OR {d.matches(f'{out}_bare', '[.!?]$')} THEN {out}_bare ELSE {d.concat(f'{out}_bare', d.lit('.'))} END"),
        (out, lambda d: cap(d, f"{out}_closed")),
    ]


# ------------------------------------------------------------------ rules


def valid_goal(d: Spark, x: str) -> str:
    return d.matches(trim(d, x), C.GOAL)


def valid_title(d: Spark, x: str) -> str:
    return f"({word_count(d, x)} BETWEEN 2 AND 3 AND {d.matches(trim(d, x), '^[A-Z]')})"


def valid_action_name(d: Spark, x: str) -> str:
    return f"({trim(d, x)} <> '' AND NOT {contains_url(d, x)} AND {word_count(d, x)} <= 8 AND {d.matches(trim(d, x), '^[A-Z0-9]')})"


def valid_description(d: Spark, x: str) -> str:
    return f"(NOT {contains_url(d, x)} AND lower({trim(d, x)}) LIKE 'it will%' AND {word_count(d, x)} BETWEEN 5 AND 7)"


def valid_step(d: Spark, x: str) -> str:
    return f"(length({trim(d, x)}) > 3 AND NOT {contains_url(d, x)})"


# ------------------------------------------------------------------ screens


def tokens(source: str, out: str = "terms") -> list[Stage]:
    plain = lambda d: d.split(d.replace(f"lower({spaces(d, source)})", r"[^a-z0-9\s-]", " "), r"\s+")
    return [(out, lambda d: d.keep(plain(d), lambda e: f"length({e}) > 1 AND NOT {d.among(e, C.SEARCH_STOPS)}"))]


def usable_target(source: str, out: str = "usable") -> list[Stage]:
    t = f"{out}_terms"
    return [
        *tokens(source, t),
        (out, lambda d: f"(length({trim(d, source)}) >= 3 AND {d.matches(source, '[A-Za-z]')} AND NOT {d.matches(trim(d, source), C.FRAGMENT)} AND {d.size(t)} > 0 AND {d.size(d.keep(t, lambda e: f'NOT {d.among(e, C.GENERIC_CONTROLS)}'))} > 0)"),
    ]


def polarity(d: Spark, x: str) -> str:
    """x: the steps' text in lower case."""
    return f"CASE WHEN {d.matches(x, C.TURNS_OFF)} THEN 'off' WHEN {d.matches(x, C.TURNS_ON)} THEN 'on' ELSE 'open' END"


def opens_settings(d: Spark, x: str) -> str:
    return f"({d.matches(x, C.ON_SETTINGS)} AND NOT {d.matches(x, C.OFF_SCREEN)})"


def category(d: Spark, x: str) -> str:
    hits = lambda ps: " + ".join(f"CASE WHEN {d.matches(x, '(?i)' + p)} THEN 1 ELSE 0 END" for p in ps)
    return f"CASE WHEN {d.matches(x, C.CRITICAL)} THEN 'critical' WHEN ({hits(C.ON_SCREEN)}) = 0 THEN 'manual' WHEN ({hits(C.PHYSICAL)}) > ({hits(C.ON_SCREEN)}) THEN 'manual' ELSE 'auto' END"
