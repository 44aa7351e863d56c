"""Text functions: characters, tokens, surfaces, typography, identifiers."""

import re
import unicodedata
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom import schema as S
from spanloom.functions.arrays import let, positions


def characters(text: Column) -> Column:
    """Code points of a text as an array (``['']`` for the empty text)."""

    return F.split(text, "")


def cut(chars: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` out of an array of characters, without rescanning the text."""

    return F.array_join(F.slice(chars, (start + 1).cast("int"), (end - start).cast("int")), "")


def surface(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` for a single span."""

    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def with_surfaces(text: Column, entities: Column) -> Column:
    """Entities of one record, each with its surface; linear in text plus surfaces."""

    return let(
        characters(text),
        lambda chars: F.transform(
            entities,
            lambda e: F.struct(
                e["label"].alias("label"),
                e["start"].alias("start"),
                e["end"].alias("end"),
                cut(chars, e["start"], e["end"]).alias("surface"),
            ),
        ),
    )


def space_tokens(text: Column) -> Column:
    """Non-empty pieces between single spaces: ``array<struct<pos,tok,start,end>>``.

    ``pos`` counts every piece, also the empty ones that are dropped.
    """

    def build(blanks: Column) -> Column:
        pieces = F.transform(
            F.split(text, " "),
            lambda tok, k: F.struct(
                k.cast("bigint").alias("pos"),
                tok.alias("tok"),
                F.when(k == 0, F.lit(0)).otherwise(F.get(blanks, k - 1) + 1).cast("bigint").alias(
                    "start"
                ),
                F.coalesce(F.get(blanks, k), F.length(text)).cast("bigint").alias("end"),
            ),
        )
        return F.filter(pieces, lambda p: p["start"] < p["end"])

    return let(positions(characters(text), lambda c: c == " "), build)


def normalize_apostrophes(text: Column) -> Column:
    """Unify apostrophes inside o/g digraphs; the length, hence every span, is kept."""

    return F.regexp_replace(text, _APOSTROPHE, S.O_G_LETTER_MARK)


def apostrophe_matches(text: Column) -> Column:
    """The apostrophe variants that ``normalize_apostrophes`` would replace."""

    return F.regexp_extract_all(text, F.lit(_APOSTROPHE), F.lit(0))


# A variant after o/g and before an ASCII letter, unless that letter is a final s/S.
_APOSTROPHE = (
    r"(?<=[oOgG])[" + S.O_G_APOSTROPHES + r"](?=[A-Za-z])(?![sS](?:\z|\P{L}))"
)


def quote_regex(literal: Column) -> Column:
    """Escape a string column for use inside a Java pattern."""

    return F.concat(F.lit("\\Q"), F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def occurrence_starts(text: Column, needle: Column) -> Column:
    """Start of every exact occurrence of a non-empty needle, self-overlapping ones too.

    Each character at which no occurrence begins is overwritten by a filler that
    differs from the needle's first character; what is left marks the starts.
    """

    filler = F.when(F.startswith(needle, F.lit("0")), F.lit("1")).otherwise(F.lit("0"))
    mask = F.regexp_replace(text, F.concat(F.lit("(?s)(?!"), quote_regex(needle), F.lit(").")), filler)
    starts = let(
        filler,
        lambda f: positions(characters(mask), lambda c: (c != f) & (c != "")),
    )
    return F.when(F.contains(text, needle), starts).otherwise(F.array().cast("array<int>"))


def expand_suffix(text: Column, end: Column) -> Column:
    """Move ``end`` over directly attached letters, digits and joining characters."""

    rest = F.substring(text, (end + 1).cast("int"), F.length(text))
    return end + F.length(F.regexp_extract(rest, f"^[\\p{{L}}\\p{{N}}{_SUFFIX_CLASS}]*", 0))


_SUFFIX_CLASS = S.SUFFIX_CHARS.replace("-", "") + "-"


class _Joining(dict):
    """Whether a character continues a suffix, looked up once for each distinct one."""

    def __missing__(self, char: str) -> bool:
        self[char] = found = char in S.SUFFIX_CHARS or unicodedata.category(char)[0] in "LN"
        return found


def _suffix_ends(text: str | None, ends: list[int | None], joining: _Joining) -> list[int | None]:
    """The next stop at or after each end; the ends are taken in order, so no character is looked at twice."""

    if text is None:
        return [None] * len(ends)
    size = len(text)
    moved, stop = {}, 0
    for end in sorted({e for e in ends if e is not None and 0 <= e < size}):
        stop = max(stop, end)
        while stop < size and joining[text[stop]]:
            stop += 1
        moved[end] = stop
    return [moved.get(e, size) for e in ends]


def _suffix_batch(texts: pa.Array, ends: pa.Array) -> pa.Array:
    joining = _Joining()
    found = [None if e is None else _suffix_ends(t, e, joining) for t, e in zip(texts.to_pylist(), ends.to_pylist(), strict=True)]
    return pa.array(found, pa.list_(pa.int64()))


# declared non-deterministic so that the optimizer never evaluates it twice
_suffixes = F.arrow_udf(_suffix_batch, T.ArrayType(T.LongType())).asNondeterministic()


def expand_suffixes(text: Column, entities: Column) -> Column:
    """``expand_suffix`` for all entities of a record in one pass over the text, in Arrow batches.

    ``entities`` is read twice, so callers give a column and not the expression that computes it.
    """

    moved = _suffixes(text, F.transform(entities, lambda e: e["end"].cast("bigint")))
    both = F.arrays_zip(entities.alias("e"), moved.alias("x"))
    return F.transform(both, lambda z: z["e"].withField("end", z["x"]))


@F.pandas_udf(T.StringType())
def _literal(values: pd.Series) -> pd.Series:
    return values.map(repr, na_action="ignore")


def _beyond_ascii(value: Column) -> Column:
    return value.rlike(r"[^\x00-\x7F]")


def _clean(value: str) -> str:
    plain = unicodedata.normalize("NFKC", value).translate(str.maketrans(dict.fromkeys(S.VALUE_APOSTROPHES, "'")))
    return re.sub(r"\s+", " ", plain).strip(S.EDGE_PUNCTUATION)


def _clean_batch(values: pd.Series) -> pd.DataFrame:
    """Each distinct value of a batch once: surfaces repeat."""

    codes, distinct = pd.factorize(values)
    cleaned = [_clean(v) for v in distinct]
    keys = [v.casefold() for v in cleaned]
    take = lambda found: [found[i] if i >= 0 else None for i in codes]
    return pd.DataFrame({"cleaned": take(cleaned), "key": take(keys)}, dtype=object)


_cleaned = F.pandas_udf(
    _clean_batch, T.StructType([T.StructField("cleaned", T.StringType()), T.StructField("key", T.StringType())])
)


def cleaned_surface(value: Column) -> Column:
    """``struct<cleaned,key>``: harmless typography removed, spelling and case kept, and the case folded key.

    Values with a non-ASCII character travel to Python, once for both, each distinct one of a batch being
    worked on once; all others stay in the JVM.
    """

    foreign = _cleaned(F.when(_beyond_ascii(value), value))
    straight = F.translate(value, S.VALUE_APOSTROPHES, "'" * len(S.VALUE_APOSTROPHES))
    plain = F.btrim(F.regexp_replace(straight, r"[\s\x1c-\x1f]+", " "), F.lit(S.EDGE_PUNCTUATION))
    return F.struct(
        F.coalesce(foreign["cleaned"], plain).alias("cleaned"), F.coalesce(foreign["key"], F.lower(plain)).alias("key")
    )


def clean_value(value: Column) -> Column:
    """Harmless typography removed, spelling and case kept."""

    return cleaned_surface(value)["cleaned"]


def casefold_key(value: Column) -> Column:
    """Case-insensitive lookup key of a surface."""

    return cleaned_surface(value)["key"]


def quoted(value: Column) -> Column:
    """The value as a quoted, escaped literal for report lines."""

    plain = ~value.rlike(r"[^ -~]|['\\]")
    return F.coalesce(
        _literal(F.when(~plain, value)), F.concat(F.lit("'"), value, F.lit("'"))
    )


def digest_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` + SHA-256 of the parts joined by NUL."""

    nul = F.char(F.lit(0))
    joined = reduce(lambda left, right: F.concat(left, nul, right), parts)
    return F.concat(F.lit(prefix), F.sha2(joined, 256))


def source_hash(row_id: Column, text: Column, position: Column | None = None) -> Column:
    """Identifier of a parallel-array row; a missing id falls back to its position."""

    key = row_id.cast("string")
    return digest_id(S.ARRAY_HASH_PREFIX, F.coalesce(key, position) if position is not None else key, text)


def sentence_hash(sheet: Column, sentence_id: Column, text: Column) -> Column:
    """Identifier of a converted token-table sentence."""

    return digest_id(S.TOKEN_HASH_PREFIX, sheet, sentence_id, text)


def augmented_hash(record_hash: Column, variant: Column, text: Column) -> Column:
    """Identifier of an augmented variant."""

    return digest_id(
        S.VARIANT_HASH_PREFIX, record_hash, F.lit("cluster"), variant.cast("string"), text
    )


def mapped_label(label: Column, table: dict[str, str]) -> Column:
    """Target label out of a fixed small table, NULL when unmapped."""

    return F.coalesce(*[F.when(label == source, F.lit(target)) for source, target in table.items()])


def seeded_key(seed: int, *parts: Column) -> Column:
    """Reproducible pseudo-random hex key, uniform whatever the data look like."""

    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def seeded_number(seed: int, *parts: Column) -> Column:
    """Integer in [0, 2^32) from ``seeded_key``."""

    return F.conv(F.substring(seeded_key(seed, *parts), 1, 8), 16, 10).cast("bigint")
