"""Personal data in texts, and the words that give it away. DataFrame functions only.

Four kinds are found by pattern (e-mail, ip, card, phone). Every value found is a protected entity. Words within
CONTEXT characters of an entity are its terms; over the whole corpus it is counted how often a term occurs at all and
how often next to that entity. A term discloses an entity if an observer who sees it learns it: the conditional
probability of the entity given the term and the pointwise mutual information in bits both reach their thresholds. Every
pair is measured; a pair met few times is held to a lower bound of the probability (Wilson, one standard error), in which
copies of a passage count once. Disclosing terms are marked wherever they occur, and
`sanitise` generalises entities to their kind and removes disclosing terms.

Cases: null and empty texts have no spans; matches that fail a check (ip parts, Luhn, digit counts) are dropped and the
search goes on after them; texts of any length are searched whole; term spans depend on the text alone, so repeated
rows and repeated ids get the same ones; without disclosing terms only the pattern spans are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portentia.runtime import stage

#: Possessive repeats where giving back could not help, so that no text makes a search quadratic or recursive. An
#: e-mail or ip starts where its run of characters starts, or where the last match ended (\\G).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
WORD_GAP = r"[^\p{L}\p{M}\p{N}]+"
#: Characters on each side of an entity in which words count as its terms.
CONTEXT = 80
#: Lower bound of the conditional probability, and bits at that bound, from which a term discloses an entity.
MIN_PROBABILITY, MIN_BITS = 0.5, 6.0


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Do the digits pass the Luhn check?"""
    place = F.sequence(F.lit(1), F.length(number))
    total = F.aggregate(
        place,
        F.lit(0),
        lambda acc, i: acc + F.when((F.length(number) - i) % 2 == 0, F.substring(number, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(number, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(
            F.split(value, r"\."),
            lambda part: (F.length(F.regexp_replace(part, "^0+", "")) <= 3)
            & (F.coalesce(F.nullif(F.regexp_replace(part, "^0+", ""), F.lit("")), F.lit("0")).substr(1, 3).cast("int") <= 255),
        )
    n = F.length(digits(value))
    if kind == "card":
        return n.between(13, 19) & luhn(digits(value))
    return n.between(9, 15)


def _valid(kind: str):
    return lambda s: valid(kind, s["value"])


def _entity(kind: str):
    def of(s: Column) -> Column:
        value = digits(s["value"]) if kind in ("card", "phone") else F.lower(s["value"])
        return F.struct(
            F.concat(F.lit(f"{kind}:"), value).alias("entity"), F.concat(s["before"], F.lit("\n"), s["after"]).alias("context")
        )

    return of


def _cut(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("" if kind == "term" else f"<{kind}>").alias("by"))


def located(found: Column, pieces: Column) -> Column:
    """Spans (start, end, value, before, after) from the matches and the pieces of text around them."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    walked = F.aggregate(
        F.sequence(F.lit(1), F.size(found)),
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda acc, i: F.struct(
            (acc["at"] + F.length(F.element_at(pieces, i)) + F.length(F.element_at(found, i))).alias("at"),
            F.array_append(
                acc["spans"],
                F.struct(
                    (acc["at"] + F.length(F.element_at(pieces, i))).alias("start"),
                    (acc["at"] + F.length(F.element_at(pieces, i)) + F.length(F.element_at(found, i))).alias("end"),
                    F.element_at(found, i).alias("value"),
                    F.right(F.element_at(pieces, i), F.lit(CONTEXT)).alias("before"),
                    F.left(F.element_at(pieces, i + 1), F.lit(CONTEXT)).alias("after"),
                ),
            ).alias("spans"),
        ),
    )["spans"]
    return F.when(F.size(found) > 0, walked).otherwise(empty)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, a key of the text, its length in words, and for each kind the valid spans in order.

    Each pattern runs over a text once; only where it matches is the text split to find the places.
    """
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    for kind, pattern in KINDS.items():
        df = df.withColumn(f"{kind}_found", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    spans = [
        F.filter(
            located(F.col(f"{kind}_found"), F.when(F.size(f"{kind}_found") > 0, F.split("text", pattern, -1))),
            _valid(kind),
        ).alias(kind)
        for kind, pattern in KINDS.items()
    ]
    return df.select("doc_id", text_key().alias("text_key"), *spans)


def text_key() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _no_entities(text: Column) -> Column:
    for pattern in KINDS.values():
        text = F.regexp_replace(text, pattern, "\n")
    return text


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_GAP), lambda w: F.length(w) > 1)


def lower_bound(share: Column, trials: Column) -> Column:
    """Wilson's lower bound, at one standard error, of a probability seen as `share` of so many trials."""
    spread = F.sqrt(share * (1 - share) / trials + 1 / (4 * trials * trials))
    return (share + 1 / (2 * trials) - spread) / (1 + 1 / trials)


def disclosing_terms(
    base: DataFrame, docs: DataFrame, min_probability: float = MIN_PROBABILITY, min_bits: float = MIN_BITS
) -> DataFrame:
    """(term, entity, together, occurrences, bits) of the terms that disclose an entity.

    Next to entities: one row per word of a context, reduced per (entity, term). The words of all texts are reduced to
    one count per term before they are shuffled and meet the pairs.
    """
    near = base.select(
        F.explode(F.concat(*[
            F.transform(kind, _entity(kind)) for kind in KINDS
        ])).alias("x")
    ).select("x.entity", _no_entities(F.col("x.context")).alias("context"))
    near = stage(near, "contexts")
    words = near.select("entity", F.xxhash64("context").alias("place"), F.explode(F.array_distinct(_terms(F.col("context")))).alias("term"))
    once = words.groupBy("entity", "term", "place").agg(F.count("*").alias("n"))
    pairs = once.groupBy("entity", "term").agg(F.sum("n").alias("together"), F.count("*").alias("contexts"))
    pairs = stage(pairs, "term_pairs")
    candidates = pairs.select("term").distinct()
    total = docs.select(F.size(_terms(F.coalesce("text", F.lit("")))).alias("n")).agg(F.sum("n")).first()[0] or 0
    spoken = docs.select(F.explode(_terms(F.coalesce("text", F.lit("")))).alias("term"))
    spoken = spoken.groupBy("term").agg(F.count("*").alias("occurrences")).join(candidates, "term", "left_semi")
    share = near.groupBy("entity").agg(F.sum(F.size(_terms(F.col("context")))).alias("around"))
    found = pairs.join(spoken, "term").join(share, "entity")
    share_of = F.least(F.lit(1.0), F.col("together") / F.col("occurrences"))
    found = found.withColumn("probability", lower_bound(share_of, F.col("contexts") / share_of))
    found = found.withColumn("bits", F.log2(F.col("probability") * F.lit(float(max(total, 1))) / F.greatest("around", F.lit(1))))
    return found.where((F.col("probability") >= min_probability) & (F.col("bits") >= min_bits)).select(
        "term", "entity", "together", "occurrences", "bits"
    )


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(text_key, terms: spans in order) of the texts that hold a disclosing term."""
    words = docs.select(text_key().alias("text_key"), F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    held = words.join(terms.select("term").distinct(), "term").groupBy("text_key").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    either = F.concat_ws("|", F.transform("terms", lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))))
    p = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}\p{N}])(?:"), either, F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    texts = docs.select(text_key().alias("text_key"), "text").join(held, "text_key").dropDuplicates(["text_key"])
    found = texts.withColumn("p", p).withColumn("found", F.regexp_extract_all("text", F.col("p"), F.lit(0)))
    placed = located(F.col("found"), F.split("text", F.col("p"), -1))
    return found.select("text_key", F.transform(placed, lambda s: F.struct(s["start"], s["end"], s["value"])).alias("term"))


def find_spans(docs: DataFrame, **thresholds: float) -> DataFrame:
    """doc_id, text_key and the spans of every kind; `term` holds those of disclosing terms."""
    base = stage(base_spans(docs), "base_spans")
    terms = stage(disclosing_terms(base, docs, **thresholds), "terms")
    return base.join(term_spans(docs, terms), "text_key", "left")


def joined(kind: str) -> Column:
    return F.transform(F.coalesce(F.col(kind), F.array()), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def sanitise(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id and the text with entities generalised to their kind and disclosing terms removed."""
    cuts = F.concat(*[F.transform(F.coalesce(F.col(k), F.array()), _cut(k)) for k in (*KINDS, "term")])
    clean = F.aggregate(
        F.array_sort(cuts),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, c: F.when(
            c["start"] >= acc["at"],
            F.struct(c["end"].alias("at"), F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, c["start"] - acc["at"]), c["by"]).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], c["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text"))),
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key().alias("text_key"))
    marks = spans.drop("doc_id").dropDuplicates(["text_key"])
    return texts.join(marks, "text_key").select("doc_id", clean.alias("text"))
