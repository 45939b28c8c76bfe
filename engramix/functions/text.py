"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramix import vocab

# Accented letters and their bases, in the same order: fixed values.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def fold(text: Column) -> Column:
    """Lower case, without accents; plain ASCII skips the character map."""
    low = F.lower(text)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, _ACCENTED, _PLAIN))


def caseless(text: Column) -> Column:
    """The text, in lower case but for A-Z where it is plain ASCII."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.lower(text))


def term_text(text: Column) -> Column:
    """A text whose runs of ASCII letters, digits and all other characters' bytes are its terms(), but for the case of A-Z."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "))


def terms(text: Column) -> Column:
    """Search terms in order, with repeats: runs of letters and digits, folded."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")  # folding maps letters to letters, so it may come first


# Each letter that has accents, with them, as a class of characters.
_SPELLINGS = {p: f"[{p}{''.join(a for a, b in zip(_ACCENTED, _PLAIN, strict=True) if b == p)}]" for p in dict.fromkeys(_PLAIN)}


def found_terms(text: Column, wanted: Column) -> Column:
    """terms() of a text that are in the array `wanted` of folded terms, found without making the others."""
    spelled = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), _SPELLINGS.items(), F.array_join(F.array_sort(wanted), "|"))
    own = F.regexp_extract_all(F.lower(text), F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), spelled, F.lit(r")(?![\p{L}\p{N}])")), F.lit(0))
    return F.when(F.size(wanted) > 0, F.transform(own, lambda t: fold(t))).otherwise(F.array().cast("array<string>"))


def term_count(text: Column) -> Column:
    """How many terms a text has."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+"))


def sanitized_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def mojibake_repaired(text: Column) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), vocab.MOJIBAKE.items(), text)


def first_match(text: Column, patterns: list[tuple[str, str]], default: str) -> Column:
    out = None
    for pattern, value in patterns:
        out = F.when(text.rlike(pattern), value) if out is None else out.when(text.rlike(pattern), value)
    return out.otherwise(default)


def chunk_type(path: Column) -> Column:
    return first_match(path, vocab.TYPE_OF_PATH, "other")


def path_kind(path: Column) -> Column:
    return F.when(path.isNull() | (path == ""), "other").otherwise(first_match(path, vocab.PATH_KINDS, "other"))


def path_date(path: Column) -> Column:
    """The first YYYY-MM-DD in a path, as a date; null without one."""
    return F.try_to_date(F.nullif(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")))


def retention_override(text: Column) -> Column:
    """struct(found, days) of a `<!-- retention: ... -->` line among the first 30; days null: for ever."""
    head = F.array_join(F.slice(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), 1, 30), "\n")
    raw = F.lower(F.trim(F.regexp_extract(head, r"(?im)^[ \t]*<!--\s*retention:\s*([^-\s][^-]*?)\s*-->[ \t]*$", 1)))
    number = F.regexp_extract(raw, r"^(\d+)", 1).try_cast("bigint")
    forever = raw.isin("never", "null", "infinite")
    fits = (number >= 1) & (number <= 36500)
    return F.struct(F.coalesce(forever | fits, F.lit(False)).alias("found"), F.when(~forever & fits, number.cast("int")).alias("days"))


def one_liner(text: Column, limit: int = 140) -> Column:
    """The first line with content, without tags and markers, cut to `limit` characters."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), r"\s+", " ")))
    real = F.filter(lines, lambda x: (x != "") & (x != "---") & (x != "```"))
    bare = F.transform(real, lambda x: F.trim(F.replace(F.regexp_replace(F.regexp_replace(x, r"^#{1,6}\s+", ""), r"^[-*>]\s+", ""), F.lit("**"), F.lit(""))))
    first = F.coalesce(F.get(F.filter(bare, lambda x: x != ""), F.lit(0)), F.lit(""))
    return F.when(F.length(first) > limit, F.concat(F.substring(first, 1, limit - 1), F.lit("…"))).otherwise(first)


def title_of(path: Column) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    return F.when(path.isNull() | (path == ""), "(no source)").otherwise(F.regexp_replace(F.when(base == "", path).otherwise(base), r"(?i)\.(md|txt|json|jsonl)$", ""))


def signature(title: Column, line: Column) -> Column:
    """Distinct tokens of four characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", title, line)), r"[^\p{L}\p{N}.]+"), lambda t: F.length(t) >= 4))


def containment(a: Column, b: Column, least: int = 3) -> Column:
    """Share of the smaller set that is in the other; 0 if either has fewer than `least`."""
    return F.when((F.size(a) < least) | (F.size(b) < least), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def shingles(text: Column, k: int = 3, prefix: int = 180) -> Column:
    """Distinct runs of k words of the text's beginning; fewer words: all of them as one."""
    words = F.filter(F.split(F.lower(F.substring(text, 1, prefix)), r"\s+"), lambda t: t != "")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (k - 1))), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.array_distinct(F.when(F.size(words) < k, F.array(F.array_join(words, " "))).otherwise(runs))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def entity_key(name: Column) -> Column:
    """Folded, runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(fold(name), r"[^a-z0-9]+", " "))


def noise_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(fold(text), r"[^a-z0-9_\s]", ""), r"\s+", " "))


def is_noise(text: Column, learned: list[str] | None = None) -> Column:
    """Short replies, bare punctuation, known phrases, and up to three words that all are words of known phrases."""
    t = F.trim(text)
    known = sorted({_folded(x) for x in [*vocab.NOISE, *(learned or [])]})
    ends = sorted({w for x in known for w in x.split()} | set(known))
    words = F.filter(F.split(noise_key(t), r"\s+"), lambda w: F.length(w) > 1)
    patterned = reduce(lambda a, b: a | b, [t.rlike(p) for p in vocab.NOISE_PATTERNS])
    phrase = (noise_key(t) == "") | noise_key(t).isin(known) | ((F.size(words) <= 3) & F.forall(words, lambda w: w.isin(ends)))
    return F.when(F.length(t) <= 10, True).when(F.length(t) >= 500, False).otherwise(patterned | phrase)


def _folded(text: str) -> str:
    import re

    table = dict(zip(_ACCENTED, _PLAIN, strict=True))
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9_\s]", "", "".join(table.get(c, c) for c in text.lower()))).strip()


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    places = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).try_cast("int")
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(places, F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def cards(text: Column) -> Column:
    """Distinct 16-digit numbers with a valid check digit, as written."""
    return F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({vocab.CARD})"), F.lit(1))), lambda m: luhn(F.regexp_replace(m, r"[-\s]", "")))


def redacted(text: Column) -> Column:
    """struct(text, count, kinds): secrets replaced by [REDACTED:kind], kind by kind in a fixed order.

    The steps are folded over an array, so each sees the one before once; nested calls would repeat all earlier steps."""
    told = lambda k: "Authorization: [REDACTED:auth-header]" if k == "auth-header" else f"[REDACTED:{k}]"
    steps = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(p).alias("pattern"), F.lit(told(k)).alias("by")) for k, p in vocab.SECRETS))
    start = F.struct(text.alias("text"), F.lit(0).cast("long").alias("count"), F.array().cast("array<string>").alias("kinds"))

    def replaced(so_far: Column, pattern: Column, by: Column, n: Column, kinds: Column) -> Column:
        return F.struct(F.regexp_replace(so_far["text"], pattern, by).alias("text"), (so_far["count"] + n).alias("count"), kinds.alias("kinds"))

    def step(so_far: Column, x: Column) -> Column:
        n = F.regexp_count(so_far["text"], x["pattern"])
        return F.when(n > 0, replaced(so_far, x["pattern"], x["by"], n, F.concat(so_far["kinds"], F.array(x["kind"])))).otherwise(so_far)

    def card(so_far: Column, number: Column) -> Column:
        pattern = F.concat(F.lit(r"\b"), number, F.lit(r"\b"))
        return replaced(so_far, pattern, F.lit(told("credit-card")), F.regexp_count(so_far["text"], pattern), F.array_union(so_far["kinds"], F.array(F.lit("credit-card"))))

    done = F.transform(F.array(F.aggregate(steps, start, step)), lambda r: F.aggregate(cards(r["text"]), r, card))
    return F.when(text.isNotNull(), F.element_at(done, 1))


def facts(text: Column) -> Column:
    """array<struct<kind, match>> of structured facts: money, tax numbers, dates, phones, addresses, names."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda m: F.struct(F.lit(kind).alias("kind"), F.trim(m).alias("match")))

    return F.flatten(F.array(*(of(k, p) for k, p in vocab.FACTS)))


def iso_week(day: Column) -> Column:
    return F.concat(F.date_part(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def fingerprint(path: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(path, F.lit("\0"), text), 256), 1, 32)


def query_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 16)


def rolling_hash(text: Column) -> Column:
    """r + base 36 of the absolute 32-bit rolling hash h * 31 + c over the characters."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    wrap = lambda h: F.pmod(h + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: wrap(a * 31 + c))
    return F.concat(F.lit("r"), F.lower(F.conv(F.abs(h).cast("string"), 10, 36)))


def relation_reason(raw: Column, relation: Column) -> Column:
    """A known reason as given, else by the verb, else unknown."""
    r, v = F.lower(F.trim(raw)), F.lower(F.trim(relation))
    from engramix.functions.score import lookup

    return F.when(r.isin([x for x in vocab.RELATION_REASONS if x != "unknown"]), r).otherwise(lookup(v, vocab.REASON_OF_VERB, "unknown"))


def is_temporal(text: Column) -> Column:
    words = reduce(lambda a, b: a | b, [text.rlike(rf"(?iu)(?:^|\s)({p})(?=\s|[.,?!]|$)") for p in vocab.TEMPORAL_WORDS])
    return F.coalesce((F.length(F.trim(text)) >= 3) & (words | text.rlike(r"\b\d{4}-\d{2}-\d{2}\b")), F.lit(False))


def temporal_intent(text: Column, as_of: Column) -> Column:
    """struct(source, anchor date): ISO date, then month with or without a year, then an adverb, then a bare year."""
    iso = F.try_to_date(F.nullif(F.regexp_extract(text, r"\b(\d{4}-\d{2}-\d{2})\b", 1), F.lit("")))
    names = "|".join(sorted(vocab.MONTHS, key=len, reverse=True))
    shape = rf"(?iu)(?:^|\s)({names})(?:\s+(?:de\s+|of\s+)?(\d{{4}}))?(?=\s|[.,?!]|$)"
    from engramix.functions.score import lookup

    month = lookup(F.lower(F.regexp_extract(text, shape, 1)), vocab.MONTHS, None)
    given = F.regexp_extract(text, shape, 2).try_cast("int")
    this = F.year(as_of)
    year = F.coalesce(given, F.when(F.make_date(this, month, F.lit(15)) > as_of.cast("date"), this - 1).otherwise(this))
    middle = F.date_add(F.make_date(year, month, F.lit(1)), F.floor((F.day(F.last_day(F.make_date(year, month, F.lit(1)))) - 1) / 2).cast("int"))
    adverb = reduce(lambda a, b: a | b, [text.rlike(rf"(?iu)(?:^|\s)({p})(?=\s|[.,?!]|$)") for p in vocab.TEMPORAL_WORDS])
    bare = F.regexp_extract(text, r"(?:^|\s)(20\d{2})(?=\s|[.,?!]|$)", 1).try_cast("int")
    source = F.when(iso.isNotNull(), "iso_date").when(month.isNotNull(), "month_year").when(adverb, "adverbial").when(bare.isNotNull(), "year")
    anchor = F.when(iso.isNotNull(), iso).when(month.isNotNull(), middle).when(~adverb & bare.isNotNull(), F.make_date(bare, F.lit(6), F.lit(30)))
    return F.struct(source.alias("source"), anchor.alias("anchor"))


def links(text: Column) -> Column:
    """array<struct<type, slug, source>> of markdown links, wiki links and bare references to typed entities, outside code."""
    kinds = "agents?|decisions?|lessons?|projects?|persons?|people|concepts?|tools?|features?|incidents?|systems?|companies|docs?|topics?|places?|events?|entities"
    slug = r"[a-z0-9][a-z0-9_\-]*"
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", " "), r"`[^`\n]*`", " ")
    shapes = [
        ("markdown_link", rf"\[[^\]\n]+?\]\((?:\.{{1,2}}/)*(?:entities/)?({kinds})/({slug})(?:\.md)?(?:#[^)\s]*)?\)"),
        ("wikilink", rf"\[\[(?:entities/)?({kinds})/({slug})(?:#[^|\]\n]*)?(?:\|[^\]\n]+?)?\]\]"),
        ("bare_ref", rf"(?m)(?<=^|[\s(,;:'\"`])({kinds})/({slug})(?=$|[\s).,?!;:'\"`])"),
    ]

    def of(source: str, pattern: str) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(plain, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(plain, F.lit(pattern), F.lit(2)).alias("b"))
        return F.transform(both, lambda z: F.struct(z["a"].alias("type"), z["b"].alias("slug"), F.lit(source).alias("source")))

    return F.array_distinct(F.flatten(F.array(*(of(s, p) for s, p in shapes))))


def code_refs(text: Column) -> Column:
    """array<string> of references to source files, with a line if given."""
    return F.regexp_extract_all(text, F.lit(r"(?im)(?<=^|[\s(,;:'\"`])((?:src|specs|audits|eval|validation|memory|paper|docs|runbooks|scripts|lessons|benchmark)/[a-z0-9_\-/.]+\.(?:ts|js|md|sh|json|yaml|yml|sql|py)(?::\d+)?)"), F.lit(1))


def since_hours(since: Column) -> Column:
    """Hours of a span such as 24h, 30d or 2w; null if it isn't one."""
    number, unit = F.regexp_extract(since, vocab.SINCE, 1).try_cast("int"), F.regexp_extract(since, vocab.SINCE, 2)
    return number * F.when(unit == "h", 1).when(unit == "d", 24).when(unit == "w", 168)


def valid(value: Column, shape: str) -> Column:
    """Whether a parameter has its shape (vocab.SCOPE, AGENT, ...); false for null."""
    return F.coalesce(value.rlike(shape), F.lit(False))


def clamped(value: Column, least: int, most: int, default: int) -> Column:
    """A count within its bounds; the default for null and what isn't a number."""
    return F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce(value.try_cast("int"), F.lit(default))))
