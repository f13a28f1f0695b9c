"""The category trees: ids in preorder, so that a subtree is a range of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.lexicon import Lexicon
from textloom.session import shuffled


def _members(lx: Lexicon) -> DataFrame:
    return lx.tokens.select("token_id", F.explode("categories").alias("_cat")).distinct()


def by_path(lx: Lexicon, path: str) -> DataFrame:
    """The category of a path, whose part below the tree is read in lower case; a tree alone is none."""
    tree, _, rest = path.partition("/")
    return lx.categories.where(F.lit(bool(rest)) & (F.col("path") == f"{tree}/{rest.lower()}"))


def with_tokens(lx: Lexicon, min_depth: int = 0) -> DataFrame:
    """``cat_id, path, tree, token_ids`` with the tokens of exactly each category; null where there are none."""
    ids = _members(lx).groupBy("_cat").agg(F.array_sort(F.collect_set("token_id")).alias("token_ids"))
    return lx.categories.where(F.col("depth") >= min_depth).join(ids, F.col("cat_id") == F.col("_cat"), "left").select("cat_id", "path", "tree", "token_ids")


def subtree_counts(lx: Lexicon) -> DataFrame:
    """``cat_id, path, tokens`` with the tokens of any id in each category's range, retired ids included.

    Ranges are laid out id by id, at most the depth of the tree times as many rows as there are categories, so that
    the range join is an equi-join.
    """
    laid = lx.categories.where("range_hi > range_lo").select("cat_id", "path", F.explode(F.sequence(F.col("range_lo").cast("int"), F.col("range_hi").cast("int") - 1)).alias("_in"))
    return _members(lx).join(laid, F.col("_cat").cast("int") == F.col("_in")).groupBy("cat_id", "path").agg(F.countDistinct("token_id").alias("tokens"))


def descendants(categories: DataFrame) -> DataFrame:
    """``cat_id, path, descendants, by_range``: every path counts for each of its proper prefixes."""
    parts = categories.select(F.split("path", "/").alias("p"))
    prefixes = parts.where(F.size("p") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.array_join(F.slice("p", 1, i), "/"))).alias("_path"))
    counts = prefixes.groupBy("_path").agg(F.count("*").alias("n"))
    return categories.join(counts, F.col("path") == F.col("_path"), "left").select("cat_id", "path", F.coalesce("n", F.lit(0)).cast("long").alias("descendants"), (F.col("range_hi") - F.col("range_lo") - 1).cast("long").alias("by_range"))


def names(lx: Lexicon) -> DataFrame:
    """``cat_id, names``: the names on the way to each category, joined by a slash."""
    parts = lx.categories.select("cat_id", F.posexplode("fqn").alias("i", "_part"))
    own = lx.categories.select(F.col("cat_id").alias("_id"), "name")
    named = parts.join(own, F.col("_part") == F.col("_id"), "left").select("cat_id", "i", F.coalesce("name", F.lit("")).alias("name"))
    return named.groupBy("cat_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]), "/").alias("names"))


def vectors(lx: Lexicon) -> DataFrame:
    """``token_id, vectors``: the ids on the way to each category of a token, in the order of the categories."""
    v = _members(lx).join(lx.categories.select("cat_id", "fqn"), F.col("_cat") == F.col("cat_id"))
    return v.groupBy("token_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cat_id", "fqn"))), lambda x: x["fqn"]).alias("vectors"))


def distances(lx: Lexicon, pairs: DataFrame) -> DataFrame:
    """``a, b, distance`` of token pairs: mean length of the common beginning over all pairs of their categories; 0 if none."""
    v = vectors(lx)
    left = pairs.join(v.select(F.col("token_id").alias("a"), F.col("vectors").alias("_x")), "a", "left")
    both = left.join(v.select(F.col("token_id").alias("b"), F.col("vectors").alias("_y")), "b", "left")

    def common(x, y):
        return F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(x), F.size(y))), lambda i: F.slice(x, 1, i) == F.slice(y, 1, i)))

    depths = F.flatten(F.transform("_x", lambda x: F.transform("_y", lambda y: common(x, y))))
    mean = F.aggregate(depths, F.lit(0), lambda s, x: s + x) / F.size(depths)
    return both.select("a", "b", F.coalesce(F.when(F.size(depths) > 0, mean), F.lit(0.0)).alias("distance"))


def children(lx: Lexicon) -> DataFrame:
    """``cat_id, path, children``: categories directly below each."""
    n = lx.categories.where("parent_id is not null").groupBy(F.col("parent_id").alias("_p")).agg(F.count("*").alias("n"))
    return lx.categories.join(n, F.col("cat_id") == F.col("_p"), "left").select("cat_id", "path", F.coalesce("n", F.lit(0)).cast("long").alias("children"))


def ranges(lx: Lexicon, kinds: dict[str, list[str]]) -> DataFrame:
    """``kind, path, lo, hi``: the id ranges of paths by kind; a path that is missing has an empty range."""
    wanted = lx.spark.createDataFrame([(k, p) for k, ps in kinds.items() for p in ps], "kind string, _path string")
    own = wanted.join(lx.categories.select("path", "range_lo", "range_hi"), F.col("_path") == F.col("path"), "left")
    return own.select("kind", F.col("_path").alias("path"), F.coalesce("range_lo", F.lit(0)).cast("int").alias("lo"), F.coalesce("range_hi", F.lit(0)).cast("int").alias("hi"))


def in_ranges(tokens: DataFrame, ids: str, found: DataFrame) -> DataFrame:
    """Distinct ``token_id, kind`` of tokens with an id of the array ``ids`` in a range of the kind.

    Ranges are laid out id by id, no more than there are categories for each path named, for an equi-join.
    """
    laid = found.where("hi > lo").select("kind", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("_in")).distinct()
    return tokens.select("token_id", F.explode(ids).alias("_c")).join(laid, F.col("_c").cast("int") == F.col("_in")).select("token_id", "kind").distinct()


#: Paths of persons and things, for telling who a pronoun may stand for.
# Category paths below the tree of nouns and of named entities.
PERSON_PATHS = ["nouns/military/military_rank", "nouns/health_and_human/family_relation", "nouns/education/occupation", "nouns/business_and_finance/corporate_job", "nouns/personnel/individual"]
ENTITY_PATHS = [
    "nouns/transportation/aircraft", "nouns/transportation/automobile", "nouns/transportation/bycycle", "nouns/transportation/_public_transportation", "nouns/transportation/ship",
    "nouns/military/vehicle", "nouns/environment/landform", "nouns/architecture_and_construction/infrastructure", "nouns/personnel/group",
]
NER_PERSON_PATHS = ["ner/person"]
NER_ENTITY_PATHS = ["ner/facility", "ner/organization", "ner/business"]


def coreference_kinds(lx: Lexicon, person: list[str] = PERSON_PATHS, entity: list[str] = ENTITY_PATHS, ner_person: list[str] = NER_PERSON_PATHS, ner_entity: list[str] = NER_ENTITY_PATHS) -> DataFrame:
    """``token_id, is_person, is_entity``: names go by their named-entity ids, plural nouns of a person path are entities."""
    nouns = in_ranges(lx.tokens, "categories", ranges(lx, {"person": person, "entity": entity})).select("token_id", F.concat(F.lit("noun_"), "kind").alias("k"))
    names = in_ranges(lx.tokens, "ner", ranges(lx, {"person": ner_person, "entity": ner_entity})).select("token_id", F.concat(F.lit("ner_"), "kind").alias("k"))
    has = nouns.unionByName(names).groupBy("token_id").agg(F.collect_set("k").alias("ks"))
    t = lx.tokens.select("token_id", "pos").join(shuffled(has), "token_id", "left")
    in_ = lambda k: F.coalesce(F.array_contains("ks", k), F.lit(False))
    name, plural = F.col("pos").startswith("NNP"), F.col("pos") == "NNS"
    is_person = F.when(name, in_("ner_person")).when(plural, F.lit(False)).otherwise(in_("noun_person"))
    is_entity = F.when(name, in_("ner_entity")).when(plural, in_("noun_person") | in_("noun_entity")).otherwise(in_("noun_entity"))
    return t.select("token_id", is_person.alias("is_person"), is_entity.alias("is_entity"))
