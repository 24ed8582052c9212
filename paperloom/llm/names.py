"""Spellings of names that refer to one person or organisation.

Distinct spellings are parsed into folded tokens (titles, marks and bracketed additions dropped; initials apart). Three
joins follow, all on keys:

1. *Token q-grams.* Tokens whose padded 2-gram sets overlap in all but three grams can be one typing error apart
   (an error touches at most three). Grams are ordered by rarity; sets with that overlap share a gram among the four
   rarest of each (prefix filter), so only those prefixes are joined, and the survivors are checked for one edit.
2. *Spellings.* The tokens of a spelling are ordered by weight. What stays unmatched in a pair may weigh no more than
   1 - ``THRESHOLD`` of a side, so a token of the *prefix* - the heaviest tokens up to more than that share - has to be
   matched: only prefix tokens (with typing variants and the formal names of short forms) are joined, with all tokens of
   the other spelling, and together with a second token, or an initial, that both have. The first letter of a
   spelled-out token meets initials only, so two spelled-out names never meet because of a common surname and letter.
3. *Soft weighted token similarity.* Tokens are matched with weights by rarity: equal 1, typing variant 0.92, nickname or
   abbreviation 0.95, initial 0.9 of the weight of the spelled-out token. A pair holds if the matched weight reaches
   ``THRESHOLD`` of the larger side and not both sides keep a spelled-out token unmatched.

Spelled-out names form entities by connected components. A spelling with nothing but initials beside its anchor joins an
entity only if all it fits belong to one, or if a middle initial decides; the remaining ones are joined among themselves.

Defined results: null, empty and letterless names are left out; a spelling is compared exactly as it stands; repeated
rows and names count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.graph import components
from paperloom.session import cut_lineage

from .frames import plain

THRESHOLD = 0.78
PREFIX = 4
#: Shorter tokens have typing variants only beside a spelling that is ``SHORT_RATIO`` times as frequent.
VARIANT_LENGTH = 4
SHORT_RATIO = 8

# Titles and additions that name nobody.
TITLES = "dr prof professor mr mrs ms sir phd md jr sr ed eds et al the of for and f".split()
PARTICLES = "de van von der den di da du la le al el bin ibn del della ter ten".split()
# English and European short forms of given names.
NICKNAMES = {
    "alexander": "alex sandy lex sasha sascha xander al", "alexandra": "alex sandra", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs", "benjamin": "ben benny", "catherine": "cathy kate kitty cat", "charles": "charlie chuck chas",
    "christopher": "chris kit topher", "christina": "chris tina", "daniel": "dan danny", "david": "dave", "deborah": "deb debbie", "dorothy": "dot dottie", "edward": "ed ted ned eddie teddy", "eleanor": "ellie nell nora",
    "elizabeth": "liz beth betty eliza lisa bess libby lizzie", "emily": "em emmy", "francesca": "fran franca cesca frankie", "francis": "frank fran", "frederick": "fred freddie freddy fritz", "gabriela": "gabi gaby", "gabriel": "gabe",
    "gerald": "gerry jerry", "gregory": "greg gregor", "harold": "harry hal", "henry": "harry hank", "irene": "rene irena", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "johannes": "hans johan jo hannes",
    "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey jo", "joshua": "josh", "katherine": "kate kathy katie kat kit", "kenneth": "ken", "lawrence": "larry", "leonard": "leo len", "leonardo": "leo", "lucia": "lucy lu",
    "margaret": "meg maggie peggy marge greta margie", "matthew": "matt", "michael": "mike mick mickey micha", "nathaniel": "nate nat", "nicholas": "nick nicky nico", "oksana": "ksenia oxana", "oliver": "ollie oli", "pamela": "pam",
    "patricia": "pat patty trish tricia", "patrick": "pat paddy", "paolo": "paul", "peter": "pete", "philip": "phil", "philippa": "pippa pip", "quentin": "quint", "raymond": "ray", "rebecca": "becky becca bec", "renata": "rena",
    "richard": "rick dick rich ricky", "robert": "bob rob bobby robbie", "ronald": "ron", "samuel": "sam sammy", "samantha": "sam", "stefan": "steff", "stephen": "steve", "steven": "steve", "susan": "sue susie suzie",
    "theodore": "theo ted teddy", "thomas": "tom tommy", "timothy": "tim timmy", "ulrich": "uli ulli", "victoria": "vicky vicki tori vic", "vincent": "vince", "walter": "walt", "william": "bill will billy liam willy", "zachary": "zach zack zac",
}
FORMAL = {}
for _formal, _short in NICKNAMES.items():
    for _s in _short.split():
        FORMAL.setdefault(_s, set()).add(_formal)
#: Words of organisations and their common short forms.
ORGANISATION = {
    "university": "univ uni", "institute": "inst", "department": "dept dep", "national": "natl nat", "library": "lib", "academy": "acad", "sciences": "sci", "science": "sci", "centre": "ctr center cent", "research": "res",
    "technology": "tech technol", "group": "grp gp", "laboratory": "lab labs", "college": "coll", "school": "sch", "society": "soc", "association": "assoc", "foundation": "fdn found", "international": "intl int", "museum": "mus",
    "archive": "arch", "working": "wkg", "hydrology": "hydrol", "observatory": "obs", "faculty": "fac", "ministry": "min", "office": "off", "engineering": "eng", "medicine": "med", "reading": "rdg", "consortium": "cons", "council": "",
}
ACRONYMS = {"wg": "working group", "rg": "research group", "tf": "task force"}
EXPANDED = {s: w for w, short in ORGANISATION.items() for s in short.split()}
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    text = text.translate(str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"}))
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def parse(name: str) -> tuple[list[str], list[str], bool]:
    """(spelled-out tokens, initials, whether an organisation) of a name."""
    text = fold(name)
    low = text.lower()
    organisation = any(w in ORGANISATION or (w in EXPANDED and len(w) > 2) for w in _WORD.findall(low))
    if not organisation:
        text = re.sub(r"\([^)]*\)", " ", text)
    text = re.sub(r"(?<=[^\W\d_])['’](?=[^\W\d_])", "", text)
    if not organisation:
        text = re.sub(r"\b([A-Za-z])\.?\s*-\s*([A-Za-z])\b\.?(?![a-z])", r"\1. ", text)  # W.-L. is the initial of one given name
        text = re.sub(r"\b[aA][lL]-+(?=\w)", " ", text)
        text = re.sub(r"(?<=[^\W\d_])-+(?=[^\W\d_])", "", text)
    words = _WORD.findall(text)
    capitals = all(w.isupper() for w in words)
    full, initials = [], []
    for at, w in enumerate(words):
        lower = w.lower()
        if organisation:
            lower = EXPANDED.get(lower, lower)
            if lower not in TITLES and (len(lower) > 1):
                full += ACRONYMS.get(lower, lower).split()
        elif len(w) == 1:
            initials.append(lower)
        elif len(w) <= 3 and w.isupper() and not capitals and lower not in TITLES and not (lower in PARTICLES and at + 1 < len(words) and len(words[at + 1]) > 3 and words[at + 1].isupper()):
            initials += lower
        elif lower in TITLES or lower in PARTICLES:
            continue
        else:
            full.append(lower)
    return full, initials, organisation


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or exchange of neighbours turns a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    if len(a) == len(b):
        differ = [i for i in range(len(a)) if a[i] != b[i]]
        return len(differ) == 1 or (len(differ) == 2 and differ[1] == differ[0] + 1 and a[differ[0]] == b[differ[1]] and a[differ[1]] == b[differ[0]])
    short, long = sorted((a, b), key=len)
    i = 0
    while i < len(short) and short[i] == long[i]:
        i += 1
    return short[i:] == long[i + 1 :]


def short_edit(a: str, b: str) -> bool:
    """A letter left out, doubled or exchanged in a short token that is no short form itself; a substituted letter makes another name."""
    return min(len(a), len(b)) in (2, 3) and a[0] == b[0] and a not in FORMAL and b not in FORMAL and one_edit(a, b) and (len(a) != len(b) or sorted(a) == sorted(b))


def same_given(a: str, b: str) -> bool:
    """One is a short form of the other, or both are of one name."""
    fa, fb = FORMAL.get(a, set()) | {a}, FORMAL.get(b, set()) | {b}
    return bool(fa & fb)


def abbreviates(short: str, long: str) -> bool:
    return len(short) >= 3 and len(long) > len(short) + 1 and long.startswith(short)


def token_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if same_given(a, b):
        return 0.95
    if (min(len(a), len(b)) >= VARIANT_LENGTH and one_edit(a, b)) or short_edit(a, b):
        return 0.92
    return 0.0


def soft_similarity(a: tuple[list[str], list[str], bool], b: tuple[list[str], list[str], bool], weight: dict[str, float]) -> float:
    """Soft weighted token similarity of two parsed names, 0 if they contradict each other."""
    (fa, ia, oa), (fb, ib, ob) = a, b
    if oa != ob:
        return 0.0
    left, right, matched = list(fa), list(fb), 0.0
    total_a, total_b = sum(weight[t] for t in fa), sum(weight[t] for t in fb)
    for parts, wholes, one in ((left, right, True), (right, left, False)):
        # a compound name written in two words on one side
        for x, y in list(zip(parts, parts[1:])):
            whole = next((z for z in wholes if len(z) > 4 and token_likeness(x + y, z) >= 0.92), None)
            if whole and x in parts and y in parts:
                parts.remove(x)
                parts.remove(y)
                wholes.remove(whole)
                matched += 0.98 * weight[whole]
                change = weight[whole] - weight[x] - weight[y]
                total_a, total_b = (total_a + change, total_b) if one else (total_a, total_b + change)
    options = sorted(((token_likeness(x, y), x, y) for x in left for y in right), reverse=True)
    for s, x, y in options:
        if s > 0 and x in left and y in right:
            left.remove(x)
            right.remove(y)
            w = max(weight[x], weight[y])
            matched += s * w
            total_a += w - weight[x]
            total_b += w - weight[y]
    if oa:
        for x in list(left):
            for y in list(right):
                if abbreviates(x, y) or abbreviates(y, x):
                    left.remove(x)
                    right.remove(y)
                    w = max(weight[x], weight[y])
                    matched += 0.95 * w
                    total_a += w - weight[x]
                    total_b += w - weight[y]
                    break
        if left and right:
            return 0.0
    else:
        if left and right:
            return 0.0
        ia, ib = list(ia), list(ib)
        for rest, given in ((left, ib), (right, ia)):
            for x in list(rest):
                # the first initial stands for the given name, later ones for middle names
                first = given[0] if given and any(n[0] == given[0] for n in FORMAL.get(x, set()) | {x}) else None
                if first is not None:
                    given.remove(first)
                    rest.remove(x)
                    matched += (0.9 if x[0] == first else 0.8) * weight[x]
                    if rest is left:
                        total_b += weight[x]
                    else:
                        total_a += weight[x]
        for i in list(ia):
            if i in ib:
                ia.remove(i)
                ib.remove(i)
                matched += 0.3
                total_a += 0.3
                total_b += 0.3
        if ia and ib:
            return 0.0  # initials that contradict each other
    return matched / max(total_a, total_b, 1e-9)


def spellings(papers: DataFrame) -> DataFrame:
    """(name, full, initials, org, n): every distinct spelling with at least one spelled-out token; n papers have it."""
    names = papers.where("authors is not null").select(F.coalesce(F.col("id"), F.lit("")).alias("id"), F.explode("authors").alias("name")).where(F.col("name").isNotNull())
    counted = names.groupBy("name", "id").agg(F.lit(1).alias("one")).groupBy("name").agg(F.sum("one").alias("n"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parsed = [parse(x) for x in frame["name"]]
            yield pd.DataFrame({"name": frame["name"], "full": [p[0] for p in parsed], "initials": [p[1] for p in parsed], "org": [p[2] for p in parsed], "n": frame["n"]})

    return counted.mapInPandas(plain(run), "name string, full array<string>, initials array<string>, org boolean, n long").where(F.size("full") > 0)


def token_variants(tokens: DataFrame) -> DataFrame:
    """(token, variant): tokens one typing error apart, both ways, by a prefix-filtered join on 2-grams."""
    words = tokens.where(F.length("token") >= 2).select("token", "df")
    gram = F.expr("transform(sequence(1, length(token) + 1), i -> substring(concat('^', token, '$'), i, 2))")
    grams = words.select("token", "df", F.posexplode(gram).alias("at", "gram"))
    # a gram that occurs again in the token is another element of the set
    again = F.row_number().over(Window.partitionBy("token", "gram").orderBy("at"))
    grams = grams.withColumn("gram", F.concat("gram", again.cast("string"))).select("token", "df", "gram")
    frequency = grams.groupBy("gram").agg(F.count("*").alias("in"))
    ranked = grams.join(frequency, "gram").withColumn("rank", F.row_number().over(Window.partitionBy("token").orderBy("in", "gram")))
    prefix = cut_lineage(ranked.where(F.col("rank") <= PREFIX).select("gram", "token", "df"))
    a, b = prefix.select("gram", F.col("token").alias("x"), F.col("df").alias("dx")), prefix.select("gram", F.col("token").alias("y"), F.col("df").alias("dy"))
    near = (F.col("x") < F.col("y")) & (F.abs(F.length("x") - F.length("y")) <= 1)
    # letters in common bound the edit distance before anything leaves the engine
    met = a.join(b, "gram").where(near).select("x", "y", "dx", "dy").distinct().where(F.levenshtein("x", "y") <= 2)

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = [
                one_edit(x, y) if min(len(x), len(y)) >= VARIANT_LENGTH else max(dx, dy) >= SHORT_RATIO * min(dx, dy) and short_edit(x, y)
                for x, y, dx, dy in zip(frame["x"], frame["y"], frame["dx"], frame["dy"])
            ]
            yield frame.loc[keep, ["x", "y"]]

    half = cut_lineage(met.mapInPandas(plain(check), "x string, y string"))
    return half.toDF("token", "variant").unionByName(half.select(F.col("y").alias("token"), F.col("x").alias("variant")))


def linked(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spellings, links): links (a, b, score) hold between spellings a < b."""
    known = cut_lineage(spellings(papers))
    total = max(1, known.count())
    tokens = known.select("name", F.explode(F.array_distinct("full")).alias("token"))
    frequency = tokens.groupBy("token").agg(F.count("*").alias("df"))
    variants = cut_lineage(token_variants(frequency))
    soft = (
        frequency.join(variants, "token", "left")
        .join(frequency.select(F.col("token").alias("variant"), F.col("df").alias("more")), "variant", "left")
        .groupBy("token", "df")
        .agg(F.sum(F.coalesce("more", F.lit(0))).alias("more"))
        .select("token", F.log(F.lit(1.0 + total) / (F.col("df") + F.col("more"))).alias("weight"))
    )
    soft = soft.withColumn("weight", F.greatest("weight", F.lit(0.1)))
    weighted = tokens.join(soft, "token").groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias("weights"))
    known = cut_lineage(known.join(weighted, "name"))

    # the prefix: the heaviest tokens, until what is left weighs no more than may stay unmatched
    before = Window.partitionBy("name").orderBy(F.desc("weight"), "token").rowsBetween(Window.unboundedPreceding, -1)
    share = tokens.join(soft, "token").withColumn("heavier", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    share = share.withColumn("total", F.sum("weight").over(Window.partitionBy("name")))
    prefix = share.where(F.col("heavier") <= (1 - THRESHOLD) * F.col("total")).groupBy("name").agg(F.collect_list("token").alias("prefix"))

    # one row per token of a spelling, with the other tokens: as it stands, as the formal names of a short form, and two neighbours as one word
    none = F.array().cast("array<string>")
    formal = F.create_map(*(F.lit(x) for short, names in FORMAL.items() for x in (short, ",".join(sorted(names)))))
    forms = lambda t: F.array_union(F.array(t), F.split(F.coalesce(formal[t], t), ","))
    compounds = F.expr("transform(sequence(1, greatest(size(full) - 1, 1)), i -> concat(full[i - 1], coalesce(get(full, i), '')))")
    each = known.join(prefix, "name").select("name", "full", "initials", "prefix", F.explode(F.array_distinct(F.concat("full", F.when(F.size("full") > 1, compounds).otherwise(none)))).alias("token"))
    rest = F.filter("full", lambda t: t != F.col("token"))
    named = F.array_union(F.flatten(F.transform(rest, forms)), F.when(F.size("full") > 2, compounds).otherwise(none))
    named = F.when(F.array_contains("full", F.col("token")), F.array_union(named, F.when(F.size("full") > 1, compounds).otherwise(none))).otherwise(F.filter(named, lambda t: ~F.contains(F.col("token"), t)))
    letters = F.transform(F.flatten(F.transform(rest, forms)), lambda t: F.concat(F.lit("#"), F.substring(t, 1, 1)))
    own = F.transform("initials", lambda i: F.concat(F.lit("#"), i))
    alone = F.when((F.size(rest) == 0) & (F.size("initials") == 0), F.array(F.lit(""))).otherwise(none)
    # a second key that begins with '#' is an initial; marked 1 it comes from a spelled-out token, which meets initials only
    marked = lambda keys, mark: F.transform(keys, lambda k: F.struct(k.alias("second"), F.lit(mark).alias("mark")))
    seconds = F.concat(marked(F.array_distinct(named), 0), marked(F.array_distinct(own), 0), marked(F.array_distinct(letters), 1), marked(alone, 0))
    keys = each.withColumn("k", F.explode(seconds)).select(
        "name", (F.array_contains("prefix", F.col("token")) | ~F.array_contains("full", F.col("token"))).alias("heavy"), F.explode(forms(F.col("token"))).alias("token"), "k.second", "k.mark"
    )
    keys = cut_lineage(keys.groupBy("name", "token", "second", "mark").agg(F.bool_or("heavy").alias("heavy")))
    heads = keys.where("heavy").drop("heavy")
    heads = heads.unionByName(heads.join(variants, "token").select("name", F.col("variant").alias("token"), "second", "mark"))
    heads = heads.unionByName(heads.join(variants.toDF("second", "other"), "second").select("name", "token", F.col("other").alias("second"), "mark")).distinct()
    tails = keys.select(F.col("name").alias("other"), "token", "second", F.col("mark").alias("its"))
    met = heads.join(tails, ["token", "second"]).where("name != other and mark + its < 2").select(F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b")).distinct()
    side = known.select("name", F.struct("full", "initials", "org").alias("p"), "weights")
    pairs = met.join(side.toDF("a", "pa", "wa"), "a").join(side.toDF("b", "pb", "wb"), "b")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for a, b, pa, pb, wa, wb in zip(*(frame[c] for c in ("a", "b", "pa", "pb", "wa", "wb"))):
                parsed = [(list(p["full"]), list(p["initials"]), bool(p["org"])) for p in (pa, pb)]
                score = soft_similarity(*parsed, dict(wa) | dict(wb))
                if score >= THRESHOLD:
                    rows.append((a, b, score))
            yield pd.DataFrame(rows, columns=["a", "b", "score"])

    return known, cut_lineage(pairs.mapInPandas(plain(verify), "a string, b string, score double"))


def entities(papers: DataFrame) -> DataFrame:
    """(name, entity, links): every spelling with the entity it belongs to, named by one of its spellings, and the number of other spellings it is linked to directly."""
    known, links = linked(papers)
    short = known.where((F.size("full") == 1) & (F.size("initials") > 0)).select("name", F.concat_ws("", F.array_sort("initials")).alias("letters"))
    spelled = known.join(short, "name", "left_anti")
    s = cut_lineage(short)
    both = links.select("a", "b", "score").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    full_links = links.join(s.select(F.col("name").alias("a")), "a", "left_anti").join(s.select(F.col("name").alias("b")), "b", "left_anti")
    rooted = cut_lineage(components(spelled, full_links, "name"))
    fits = both.join(s.select(F.col("name").alias("a")), "a", "left_semi").join(rooted.withColumnRenamed("name", "b"), "b")
    per = fits.groupBy("a", "root").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("a").orderBy(F.desc("score"), "root")
    ranked = per.withColumn("place", F.row_number().over(rank)).withColumn("next", F.lead("score").over(rank))
    # several entities fit: only a clearly better one (a middle initial in common) decides
    chosen = cut_lineage(ranked.where("place = 1 and (next is null or score > next + 0.02)").select(F.col("a").alias("name"), "root"))
    loose = s.join(chosen, "name", "left_anti").join(fits.select(F.col("a").alias("name")).distinct(), "name", "left_anti")
    loose_links = links.join(loose.select(F.col("name").alias("a")), "a", "left_semi").join(loose.select(F.col("name").alias("b")), "b", "left_semi")
    undecided = s.join(chosen, "name", "left_anti").join(loose, "name", "left_anti").select("name", F.col("name").alias("root"))
    every = rooted.unionByName(chosen).unionByName(components(loose, loose_links, "name")).unionByName(undecided)
    degree = both.groupBy(F.col("a").alias("name")).agg(F.count("*").alias("links"))
    return every.join(degree, "name", "left").select("name", F.col("root").alias("entity"), F.coalesce("links", F.lit(0)).alias("links"))


def found(papers: DataFrame) -> DataFrame:
    """(name_a, name_b): all pairs of spellings within an entity, name_a < name_b."""
    named = cut_lineage(entities(papers))
    a, b = named.select("entity", F.col("name").alias("name_a")), named.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
