"""Column functions over text: sentences, cues, owners, deadlines, confidences, names and cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from agendum.functions import patterns as P
from agendum.functions.numbers import rounded

TERMINATORS = ".!?।"
SPACE = P.SPACE


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def normalised(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


def speech_sentences(text: Column) -> Column:
    """Split after a terminator and white space, or at line feeds; blanks go."""
    return F.filter(F.transform(F.split(text, rf"(?<=[{TERMINATORS}]){SPACE}+|\n+"), strip), lambda s: s != "")


def extractor_sentences(text: Column) -> Column:
    """As speech_sentences, but line feeds don't split."""
    return F.filter(F.transform(F.split(text, rf"(?<=[{TERMINATORS}]){SPACE}+"), strip), lambda s: s != "")


def spans(text: Column, stops: str = TERMINATORS) -> Column:
    """array<struct<text, start, end>>: runs up to a stop, with it; lone stops and line feeds only move the offset.

    For texts of a few hundred sentences, as the array is copied for each; minutes.sentences() takes any length.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"))

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        own = F.array(F.struct(strip(piece).alias("text"), state["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(is_run(piece, stops), F.concat(state["out"], own)).otherwise(state["out"]).alias("out"))

    return F.aggregate(pieces(text, stops), start, step, lambda s: s["out"])


def sparse(text: Column) -> Column:
    """Whether a text has too few terminators for its words to be split by them."""
    n, stops = n_words(text), F.length(text) - F.length(F.regexp_replace(text, f"[{TERMINATORS}]", ""))
    return (n >= 12) & ((stops == 0) | (n / stops > 40))


def pieces(text: Column, stops: str = TERMINATORS) -> Column:
    """The whole text in pieces: runs up to a stop, with it, and lone stops and line feeds."""
    return F.regexp_extract_all(text, F.lit(rf"([^{stops}\n]+[{stops}]?|[{stops}\n])"), F.lit(1))


def is_run(piece: Column, stops: str = TERMINATORS) -> Column:
    """Whether a piece is a sentence, not a lone stop or blank."""
    return ~piece.rlike(rf"^[{stops}\n]$") & (strip(piece) != "")


def by_clauses(text: Column) -> Column:
    """Whether a text is split at commas too: it is sparse, and has more clauses than sentences, but some of these."""
    count = lambda stops: F.size(F.filter(pieces(text, stops), lambda p: is_run(p, stops)))
    return sparse(text) & (count(TERMINATORS) > 0) & (count("," + TERMINATORS) > count(TERMINATORS))


def tiered_spans(text: Column) -> Column:
    """spans(), or comma clauses where terminators are too few and clauses are more."""
    return F.when(by_clauses(text), spans(text, "," + TERMINATORS)).otherwise(spans(text))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def has(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.when(is_ascii(text), text.rlike(P.plain(pattern, ignore_case))).otherwise(text.rlike(P.java(pattern, ignore_case)))


def group_1(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Group 1 of the first match, which is never empty; null without a match."""
    found = F.when(is_ascii(text), F.regexp_extract(text, P.plain(pattern, ignore_case), 1)).otherwise(F.regexp_extract(text, P.java(pattern, ignore_case), 1))
    return F.nullif(found, F.lit(""))


def first_group(text: Column, pattern_list) -> Column:
    """Group 1 of the first pattern that matches; null if none does."""
    return strip(F.coalesce(*[group_1(text, p, ignore_case) for p, ignore_case in pattern_list]))


def owner(text: Column) -> Column:
    return first_group(text, P.OWNERS)


def deadline(text: Column) -> Column:
    return first_group(text, [(p, True) for p in P.DEADLINES])


def confidence(base: float, hedged: Column, n: Column, due: Column) -> Column:
    """Base, less for hedges and few words, more for many words and a deadline; within 0.05 and 0.95."""
    score = F.lit(base) - F.when(hedged, 0.25).otherwise(0.0)
    score = score + F.when(n < 5, -0.15).when(n > 12, 0.08).otherwise(0.0) + F.when(due.isNotNull(), 0.10).otherwise(0.0)
    return rounded(F.greatest(F.lit(0.05), F.least(F.lit(0.95), score)), 2)


def rule_confidence(text: Column, base: float, due: Column | None = None) -> Column:
    return confidence(base, has(text, P.HEDGE), n_words(text), deadline(text) if due is None else due)


def languages(text: Column, hint: Column | None = None) -> Column:
    """`hi` for Devanagari, `en` for Latin letters, then the hint; `unknown` if none."""
    found = F.array_compact(F.array(F.when(text.rlike("[ऀ-ॿ]"), "hi"), F.when(text.rlike("[A-Za-z]"), "en"), hint if hint is not None else F.lit(None).cast("string")))
    found = F.array_distinct(found)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))


def primary_languages(text: Column, primary: Column) -> Column:
    """The recogniser's own language first, then `hi` and `en` by script."""
    return F.array_distinct(F.array_compact(F.array(primary, F.when(text.rlike("[ऀ-ॿ]"), "hi"), F.when(text.rlike("[A-Za-z]"), "en"))))


def sentence_language(text: Column) -> Column:
    return F.when(text.rlike("[ऀ-ॿ]") | has(text, P.ROMANISED_HINDI), "hi").otherwise("en")


def cue_hit(text: Column, kind: str, codes: Column) -> Column:
    """Whether a cue of this kind in one of the languages (English always) matches."""
    hit = has(text, P.LANGUAGE_CUES["en"][kind])
    subtags = F.transform(codes, lambda c: F.lower(F.substring_index(c, "-", 1)))
    for code, own in P.LANGUAGE_CUES.items():
        if code != "en":
            hit = hit | (F.array_contains(subtags, code) & has(text, own[kind]))
    return hit


def model_owner(text: Column, codes: Column) -> Column:
    """The first owner that isn't all capitals, English patterns before Hindi ones."""
    found = F.lit(None).cast("string")
    subtags = F.transform(codes, lambda c: F.lower(F.substring_index(c, "-", 1)))
    for code in ("hi", "en"):
        for pattern, ignore_case in reversed(P.LANGUAGE_OWNERS[code]):
            name = strip(group_1(text, pattern, ignore_case))
            fits = name.isNotNull() & ~name.rlike(r"^[A-Z0-9_:\[\]]+$")
            found = F.when(fits if code == "en" else fits & F.array_contains(subtags, code), name).otherwise(found)
    return found


def model_deadline(text: Column, codes: Column) -> Column:
    """The first deadline of the similarity-based stage, English patterns before Hindi ones."""
    hindi = F.array_contains(F.transform(codes, lambda c: F.lower(F.substring_index(c, "-", 1))), "hi")
    found = {code: first_group(text, [(p, True) for p in P.LANGUAGE_DEADLINES[code]]) for code in ("en", "hi")}
    return F.coalesce(found["en"], F.when(hindi, found["hi"]))


def neutral_cell(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(P.FORMULA_STARTS), F.concat(F.lit("'"), text)).otherwise(text)


def safe_filename(name: Column) -> Column:
    """The last part of a path of either kind, with safe characters only, at most 255."""
    base = F.regexp_extract(F.regexp_replace(F.coalesce(name, F.lit("upload")), r"[/\\]+$", ""), r"([^/\\]*)$", 1)
    base = F.regexp_replace(F.regexp_replace(base, r"^[A-Za-z]:", ""), r"[^A-Za-z0-9._-]", "_")
    base = F.regexp_replace(base, r"^\.+", "")
    base = F.replace(F.when(base == "", "upload").otherwise(base), F.lit(".."), F.lit("_"))
    stem = F.regexp_extract(base, r"^(.*)\.[^.]*$", 1)
    stem = F.when(stem == "", base).otherwise(stem)
    base = F.when(F.upper(stem).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), F.concat(F.lit("file_"), base)).otherwise(base)
    return F.substring(base, 1, 255)


def upload_kind(name: Column) -> Column:
    """`audio`, `transcript`, or null for an extension that isn't accepted."""
    ext = F.lower(F.regexp_extract(safe_filename(name), r"(?s).(\.[^.]+)$", 1))
    return F.when(ext.isin(*P.AUDIO_EXTENSIONS), "audio").when(ext.isin(*P.TEXT_EXTENSIONS), "transcript")


def content_type_allowed(content_type: Column, kind: Column) -> Column:
    plain = F.lower(strip(F.substring_index(F.coalesce(content_type, F.lit("application/octet-stream")), ";", 1)))
    return F.when(kind == "transcript", plain.isin(*P.TEXT_TYPES)).otherwise(plain.isin(*P.AUDIO_TYPES))


def looks_like_audio(content: Column) -> Column:
    head, found = F.hex(F.substring(content, 1, 16)), F.lit(False)
    for offset, signature in P.SIGNATURES:
        found = found | (F.substring(head, 2 * offset + 1, len(signature)) == signature)
    return found


def looks_like_text(content: Column) -> Column:
    """No NUL, and UTF-8 but for at most four bytes that a chunk's end cut off (first MiB)."""
    chunk = F.substring(content, 1, 1 << 20)
    ends = [F.is_valid_utf8(chunk.substr(F.lit(1), F.greatest(F.octet_length(chunk) - k, F.lit(0)))) for k in range(5)]
    valid = ends[0]
    for e in ends[1:]:
        valid = valid | e
    return ~F.hex(chunk).rlike("^(..)*00") & valid


def wer_text(text: Column) -> Column:
    return strip(F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}_{SPACE[1:-1]}]", ""))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"({P.WORD}+)"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Of the token sets; 0 if either is empty."""
    x, y = tokens(a), tokens(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((i - 1) % 2 == n % 2, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), digits.substr(i, F.lit(1)).cast("int") + 1)).otherwise(digits.substr(i, F.lit(1)).cast("int")))
    return F.when(n > 0, F.aggregate(values, F.lit(0), lambda s, x: s + x) % 10 == 0).otherwise(True)


def mm_ss(seconds: Column) -> Column:
    whole = seconds.cast("int")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("int"), whole % 60)


def fenced(text: Column, label: str = "transcript") -> Column:
    """Text marked as untrusted data, with imitations of the fence taken out."""
    safe = F.replace(F.replace(text, F.lit(P.FENCE_CLOSE), F.lit(P.FENCE_REMOVED)), F.lit(P.FENCE_OPEN), F.lit(P.FENCE_REMOVED))
    return F.concat(F.lit(P.FENCE_HEAD.format(label=label) + P.FENCE_OPEN + "\n"), safe, F.lit("\n" + P.FENCE_CLOSE))


def iso(ts: Column) -> Column:
    """An instant as text, with microseconds only where it has any; null stays null."""
    micros = F.unix_micros(ts) % 1_000_000
    return F.when(micros == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def email(text: Column) -> Column:
    return F.lower(strip(text))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON text of string and number columns with sorted keys, `, ` and `: `."""
    def value(c: Column) -> Column:
        quoted = F.get_json_object(F.to_json(F.struct(F.struct(c.alias("v")).alias("o")), {"ignoreNullFields": "false"}), "$.o")
        return F.regexp_extract(quoted, r'(?s)^\{"v":(.*)\}$', 1)

    parts = [F.concat(F.lit(f'"{k}": '), value(fields[k])) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def fingerprint(tool: Column, payload: Column) -> Column:
    return F.concat(tool, F.lit(":"), F.substring(F.sha2(payload, 256), 1, 16))
