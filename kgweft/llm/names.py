"""Linking the spellings of one person or organisation, by a pigeonhole segment join (problem 4).

Every distinct name is read into a key: family and given name of a person, place and kind of an
organisation, without titles, case, accents, order and punctuation. Keys whose main part differs by
typing errors are found with segments: of k + 1 segments at least one survives k errors, so each key is
indexed under its segments and looks up its own substrings near the same places. Candidates are verified
with the banded edit distance. Rarer readings then follow the better attested key that they fit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgweft.session import cut

# Usual short forms of given names that are not their beginnings, or that stand for one name among several.
_NICKNAMES = {
    "abigail": "abby gail", "abraham": "abe", "albert": "bert bertie", "alexander": "alex sandy sasha xander", "alexandra": "sandra lexi", "alfred": "fred alf",
    "amanda": "mandy", "andrea": "drea andi", "andrew": "andy drew", "anna": "annie nan", "anthony": "tony", "antonio": "toni", "archibald": "archie", "arthur": "art artie",
    "augustus": "gus", "barbara": "babs barb", "bartholomew": "bart", "beatrice": "bea trixie", "benjamin": "ben benny", "bernard": "bernie", "bridget": "bridie biddy",
    "caroline": "carrie caro", "catherine": "cathy cat", "cecilia": "cissy", "charles": "charlie chuck", "charlotte": "lottie", "christina": "tina", "christopher": "chris kit topher",
    "clara": "clary", "clement": "clem", "cornelius": "neil", "cynthia": "cindy", "daniel": "dan danny", "david": "dave davy", "deborah": "debbie deb", "dominic": "nick",
    "donald": "don", "dorothea": "thea dot", "dorothy": "dolly dottie", "edmund": "ned", "edward": "eddie ted teddy", "eleanor": "nell ellie nora", "elizabeth": "liz beth betty lizzie eliza elsa lisa",
    "emily": "em emmy", "ernest": "ernie", "esther": "essie", "eugene": "gene", "florence": "flo florrie", "frances": "fanny fran", "francis": "frank", "francisco": "paco pancho",
    "franziska": "franzi", "frederick": "fred freddie fritz", "friedrich": "fritz", "gabriela": "gabi", "gabriel": "gabe", "geoffrey": "jeff", "george": "georgie", "gerald": "gerry jerry",
    "gertrude": "trudy gertie", "gilbert": "gil", "giovanni": "gianni", "giuseppe": "beppe peppe", "gregory": "greg", "guillermo": "memo", "hannah": "hanna", "harold": "hal harry",
    "heinrich": "heinz", "helene": "leni", "henrietta": "etta hetty", "henry": "harry hank hal", "howard": "howie", "ignatius": "iggy", "isaac": "ike", "isabella": "bella izzy",
    "jacob": "jake", "jacqueline": "jackie", "james": "jim jimmy jamie", "jane": "janie jenny", "janet": "jan", "jeffrey": "jeff", "jennifer": "jenny jen", "jeremiah": "jerry", "jessica": "jess",
    "johann": "hans", "johannes": "hannes hans", "john": "jack johnny", "jonathan": "jon jonny", "jose": "pepe", "joseph": "joe joey", "josephine": "josie jo", "joshua": "josh",
    "judith": "judy", "julia": "jules", "karl": "kalle", "katherine": "kate kathy katie kitty kay", "kenneth": "ken kenny", "kimberly": "kim", "lawrence": "larry laurie",
    "leonard": "len lenny", "leopold": "leo poldi", "lillian": "lily", "louis": "lou louie", "louise": "lou", "lucille": "lucy", "magdalena": "lena magda", "margaret": "peggy meg maggie margie greta",
    "maria": "mia", "martha": "patty marty", "martin": "marty", "mary": "molly polly mamie", "matilda": "tilly", "matthew": "matt matty", "maximilian": "max", "michael": "mike mick micky",
    "mildred": "millie", "mikhail": "misha", "nancy": "nan", "nathaniel": "nat nate", "nicholas": "nick nicky", "nikolai": "kolya", "olivia": "liv livvy", "oliver": "ollie", "oscar": "ossie",
    "pamela": "pam", "patricia": "trish pat patty", "patrick": "paddy", "penelope": "penny", "peter": "pete", "philip": "phil", "philippa": "pippa", "priscilla": "cilla", "quentin": "quint",
    "rachel": "rae", "raymond": "ray", "rebecca": "becky", "richard": "dick rick ricky", "robert": "bob bobby rob robin", "roberta": "bobbie", "ronald": "ron ronnie", "rosalind": "roz ros",
    "rudolf": "rudi", "samantha": "sam", "samuel": "sam sammy", "sarah": "sally sadie", "sebastian": "seb basti", "sophia": "sophie", "stanley": "stan", "stephanie": "steffi steph",
    "stephen": "steve", "susanna": "sanna sue", "susan": "sue susie", "sylvester": "sly", "tatiana": "tanya", "theodore": "ted theo", "theresa": "terry tess", "thomas": "tom tommy",
    "timothy": "tim", "ulrike": "uli ulli", "ulrich": "uli", "ursula": "ulla uschi", "valentin": "val", "veronica": "ronnie", "victor": "vic", "victoria": "vicky vic", "vincent": "vince",
    "virginia": "ginny", "walter": "wally", "wilhelm": "willi", "wilhelmina": "mina minna", "william": "bill will billy liam", "winifred": "winnie", "ximena": "mena", "yolanda": "yoli", "zacharias": "zach",
}
_SHORT_OF = {full: shorts.split() for full, shorts in _NICKNAMES.items()}
_SHORT = sorted({short for shorts in _SHORT_OF.values() for short in shorts})
_TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "sir", "phd", "md", "msc", "dipl", "ing", "et", "al"}
_GENERATION = {"jr", "sr", "ii", "iii", "iv"}
# Words that tell the kind of an organisation, in the languages met.
_KINDS = {
    "university": "university", "universitat": "university", "universite": "university", "universidad": "university", "universita": "university", "univ": "university", "uni": "university",
    "hospital": "hospital", "hosp": "hospital", "klinikum": "hospital", "clinic": "clinic", "klinik": "clinic", "clinique": "clinic", "clinica": "clinic",
    "college": "college", "academy": "academy", "akademie": "academy", "academie": "academy", "academia": "academy", "museum": "museum", "observatory": "observatory", "institute": "institute", "institut": "institute", "inst": "institute", "instituto": "institute",
    "laboratories": "labs", "laboratory": "labs", "labs": "labs", "lab": "labs",
}
_LEGAL = {"ltd", "inc", "gmbh", "llc", "corp", "plc", "ag", "co", "limited", "research"}
_SMALL = {"of", "the", "for", "de", "di", "del", "la", "der", "fur", "and", "at", "in", "a"}


def fold(text: str) -> str:
    """Lower case without accents."""
    plain = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("ł", "l"))
    return "".join(c for c in plain if not unicodedata.combining(c)).lower()


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most ``k`` (banded)."""
    if abs(len(a) - len(b)) > k:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        low, high = max(1, i - k), min(len(b), i + k)
        new = [k + 1] * (len(b) + 1)
        new[0] = i
        for j in range(low, high + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        row = new
    return row[-1] <= k


@lru_cache(maxsize=100_000)
def _kind(word: str) -> str | None:
    if word in _KINDS:
        return _KINDS[word]
    if len(word) >= 7:
        return next((k for w, k in _KINDS.items() if len(w) >= 8 and within(word, w, 1 if len(word) < 9 else 2)), None)
    return None


def _organisation(words: list[str], raw: str) -> tuple[str, str] | None:
    """``(place, kind)`` if the words are those of an organisation."""
    joined = re.fullmatch(r"(\w{4,}?)(labs|laboratories)", words[0]) if len(words) == 1 else None
    if joined:
        return joined[1], "labs"
    acronym = re.search(r"[\s-]\(?(I[A-Z]{2,3})\)?$", raw)
    kinds = [_kind(w) for w in words]
    if not any(kinds):
        if acronym and len(words) == 2:
            return words[0], f"institute {fold(acronym[1])}"
        return None
    named = [k for k in kinds if k]
    rest = [w for w, k in zip(words, kinds, strict=True) if not k and w not in _SMALL and w not in _LEGAL]
    if not rest:
        return None
    if "hospital" in named:
        return " ".join(rest), "hospital"
    if "institute" in named:
        if acronym and fold(acronym[1]) in rest:
            rest.remove(fold(acronym[1]))
        at = kinds.index("institute")
        topic = [w for w in words[at + 1 :] if w not in _SMALL and w in rest]
        place = [w for w in words[:at] if w in rest]
        if not place and "," in raw:
            place = [w for w in re.findall(r"[a-z0-9]+", fold(raw.rsplit(",", 1)[1])) if w in rest]
            topic = [w for w in topic if w not in place]
        if place:
            return " ".join(place), "institute i" + "".join(w[0] for w in topic) if topic else "institute"
        return None
    return " ".join(rest), named[0]


def read(name: str | None, body: bool = False) -> tuple[str, str, str, str] | None:
    """``(kind, main, given, form)`` of a name; ``form`` is full, initial, short or open.

    ``body`` says that the name is mostly given as an organisation's; only then "U. Somewhere" is a university.

    ``open`` marks two full words without a comma, whose order is decided later. A name without letters gives null.
    """
    if name is None:
        return None
    text = fold(name)
    words = re.findall(r"[a-z0-9]+", re.sub(r"[’'`´]", "", text))
    if not any(re.search(r"[a-z]", w) for w in words):
        return None
    if body and len(words) == 2 and words[0] == "u":
        return ("o", words[1], "university", "full")
    organised = _organisation(words, name.strip())
    if organised:
        return ("o", organised[0], organised[1], "full")
    generation = "".join(w for w in words if w in _GENERATION)
    kept = [w for w in words if w not in _TITLES and w not in _GENERATION]
    if len(kept) < 2:
        return ("x", " ".join(words), "", "full")
    comma = text.split(",")
    head = [w for w in re.findall(r"[a-z0-9]+", comma[0]) if w in kept]
    tail = [w for w in re.findall(r"[a-z0-9]+", ",".join(comma[1:])) if w in kept]
    order = "full"
    if head and tail:
        family, given = head, tail
    elif len(kept[-1]) == 1 and len(kept[0]) > 1:
        family, given = [w for w in kept if len(w) > 1], [w for w in kept if len(w) == 1]
    else:
        family, given = kept[-1:], kept[:-1]
        order = "open" if len(kept) == 2 and len(kept[0]) > 1 else "full"
    kind = "p" + generation
    if len(kept) > 4:
        return ("x", " ".join(words), "", "full")
    first = given[0]
    if len(first) == 1:
        return (kind, " ".join(family), first, "initial")
    dotted = re.search(rf"\b{re.escape(first)}\.", text) is not None
    if dotted:
        return (kind, " ".join(family), first, "short")
    return (kind, " ".join(family), first, order)


def segments(text: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` segments with their places, as even as can be."""
    n, parts = len(text), k + 1
    short = n // parts
    cuts = [0]
    for i in range(parts):
        cuts.append(cuts[-1] + short + (i >= parts - n % parts))
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def probes(text: str, k: int) -> set[tuple[int, int, str]]:
    """``(length, segment number, substring)`` under which a string no longer than ``text``, ``k`` edits away at most, is indexed."""
    found = set()
    for length in range(max(k + 1, len(text) - k), len(text) + 1):
        for no, (at, part) in enumerate(segments("." * length, k)):
            for start in range(max(0, at - k), min(len(text) - len(part), at + k) + 1):
                found.add((length, no, text[start : start + len(part)]))
    return found


def segment_join(keys: DataFrame, k: int = 2) -> DataFrame:
    """``(a, b)``: ids of ``keys`` (``id``, ``block``, ``main``) of one block whose main parts are at most ``k`` edits apart.

    Strings of at most ``k`` characters have no segments and no partner here. All candidates are verified;
    none is dropped for being frequent.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, mains, asks = [], [], [], []
            for i, block, main in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(main) <= k:
                    continue
                for ask, those in ((False, {(len(main), no, s) for no, (_, s) in enumerate(segments(main, k))}), (True, probes(main, k))):
                    for length, no, part in those:
                        ids.append(i)
                        tags.append(f"{block}\t{length}\t{no}\t{part}")
                        mains.append(main)
                        asks.append(ask)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.string()), pa.array(mains, pa.string()), pa.array(asks, pa.bool_())], names=["id", "tag", "main", "ask"])

    told = cut(keys.select("id", "block", "main").mapInArrow(entries, "id long, tag string, main string, ask boolean"))
    asked, held = told.filter("ask"), told.filter("NOT ask")
    met = asked.select(F.col("id").alias("a"), "tag", F.col("main").alias("am")).join(held.select(F.col("id").alias("b"), "tag", F.col("main").alias("bm")), "tag")
    met = met.filter((F.col("a") != F.col("b")) & ((F.length("am") > F.length("bm")) | (F.col("a") < F.col("b"))))
    near = met.filter(F.levenshtein("am", "bm", k) >= 0)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _typo(a: str, b: str) -> F.Column:
    """One letter more, less or other, or two neighbours exchanged."""
    step = F.levenshtein(a, b, 2)
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    return (step == 1) | (step == 0) | ((step == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b)))


def spellings(mentions: DataFrame, types: tuple[str, ...] = ("Author", "Organisation")) -> DataFrame:
    """``(name, n, body)``: distinct names that occur as subject or obj with one of the types, how often, and whether mostly as Organisation. Nulls are left out."""
    sides = [mentions.select(F.col(s).alias("name"), F.col(f"{s}_type").alias("t")) for s in ("subject", "obj")]
    both = sides[0].unionByName(sides[1]).filter(F.col("t").isin(*types) & F.col("name").isNotNull())
    return both.groupBy("name").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.when(F.col("t") == "Organisation", 1).otherwise(-1)) > 0).alias("body"))


def _keys(names: DataFrame) -> DataFrame:
    """``(name, n, kind, main, given, form)`` with the order of open names decided.

    A word is a given name if it stands first beside more different words than it stands last. Besides, a name is
    turned where only its turned reading is also that of a name whose order is plain (by a comma or a middle initial).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [read(x, b) or ("x", x, "", "full") for x, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = [pa.array([t[i] for t in told], pa.string()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["name", "n", "kind", "main", "given", "form"])

    parsed = cut(names.mapInArrow(run, "name string, n long, kind string, main string, given string, form string"))
    people = parsed.filter(F.col("kind").startswith("p") & F.col("form").isin("full", "open"))
    first = people.select(F.col("given").alias("word"), F.col("main").alias("beside"), F.lit(1).alias("side"))
    last = people.select(F.col("main").alias("word"), F.col("given").alias("beside"), F.lit(-1).alias("side"))
    lead = first.unionByName(last).distinct().groupBy("word").agg(F.sum("side").alias("lead"))
    of = lambda c: lead.select(F.col("word").alias(c), F.col("lead").alias(f"{c}_lead"))
    judged = parsed.join(of("given"), "given", "left").join(of("main"), "main", "left")
    plain = parsed.filter(F.col("kind").startswith("p") & (F.col("form") == "full"))
    plain = plain.select("kind", "main", F.explode(F.array_union(F.array("given"), _shorts(F.col("given")))).alias("given")).distinct()
    judged = judged.join(plain.withColumn("as_read", F.lit(True)), ["kind", "main", "given"], "left")
    judged = judged.join(plain.select("kind", F.col("main").alias("given"), F.col("given").alias("main"), F.lit(True).alias("as_turned")), ["kind", "given", "main"], "left")
    known = F.col("as_turned").isNotNull() & F.col("as_read").isNull()
    turn = (F.col("form") == "open") & F.col("as_read").isNull() & (known | (F.coalesce("main_lead", F.lit(0)) > 1) & (F.coalesce("given_lead", F.lit(0)) < F.coalesce("main_lead", F.lit(0))))
    turned = judged.select("name", "n", "kind", F.when(turn, F.col("given")).otherwise(F.col("main")).alias("main"), F.when(turn, F.col("main")).otherwise(F.col("given")).alias("given"), "form")
    short = F.col("kind").startswith("p") & F.col("form").isin("full", "open") & F.col("given").isin(_SHORT)
    return turned.withColumn("form", F.when(short, "nick").when(F.col("form") == "open", "full").otherwise(F.col("form")))


def _shorts(given: F.Column) -> F.Column:
    """Usual short forms of a given name, perhaps none."""
    known = F.create_map(*[x for full, shorts in _SHORT_OF.items() for x in (F.lit(full), F.array(*map(F.lit, shorts)))])
    return F.coalesce(known[given], F.array().cast("array<string>"))


def _closed(root: DataFrame) -> DataFrame:
    """``(id, root)`` with every chain followed to its end, each round doubling the steps."""
    while True:
        root = cut(root.join(root.select(F.col("id").alias("root"), F.col("root").alias("above")), "root").select("id", F.col("root").alias("was"), F.col("above").alias("root")))
        if root.filter("root <> was").isEmpty():
            return root.select("id", "root")
        root = root.select("id", "root")


def link(mentions: DataFrame, types: tuple[str, ...] = ("Author", "Organisation"), *, k: int = 2) -> DataFrame:
    """``(name, entity)``: every distinct spelling with the number of the person or organisation that it names.

    Persons are told apart by family and given name: initials and short forms follow the only full name that
    they fit, and stay apart where several fit; a short form that fits none is a name of its own. A reading with a
    typing error follows the best attested reading one error away, where it stands in two spellings at most or in
    a third of the other's at most. Organisations are told apart by place and kind: a university and its hospital
    are two. A generation (Jr.) makes another person. Case, accents, spacing, titles and order don't count.
    Repeated rows and extra columns change nothing; an empty table gives no rows.
    """
    named = cut(_keys(spellings(mentions, types)).withColumn("id", F.xxhash64("kind", "main", "given", "form")))
    keys = cut(
        named.groupBy("id").agg(
            F.first("kind").alias("kind"), F.first("main").alias("main"), F.first("given").alias("given"), F.first("form").alias("form"),
            F.count(F.lit(1)).alias("strings"), F.sum("n").alias("n"),
        )
    )
    person, by_letter = F.col("kind").startswith("p"), F.create_map(*[x for short in _SHORT for x in (F.lit(short), F.array(*[F.lit(i) for i in sorted({full[0] for full in _SHORT_OF if short in _SHORT_OF[full]})]))])
    letters = F.array_union(F.array(F.substring("given", 1, 1)), F.coalesce(by_letter[F.col("given")], F.array().cast("array<string>")))
    blocks = keys.select("id", "main", "kind", F.explode(F.when(person, letters).otherwise(F.array("given"))).alias("part")).select("id", "main", F.concat_ws(" ", "kind", "part").alias("block"))
    side = lambda of, p: of.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "kind", "main", "given", "form", "strings", "n")])

    def ways(near: DataFrame, of: DataFrame) -> DataFrame:
        both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        return both.join(side(of, "a"), F.col("a") == F.col("a_id")).join(side(of, "b"), F.col("b") == F.col("b_id")).drop("a", "b")

    slips = cut(segment_join(blocks, k))
    # a short form with no full name to follow is a full name
    tags = F.array_union(F.transform(F.sequence(F.lit(1), F.greatest(F.length("given"), F.lit(1))), lambda i: F.concat(F.lit("p"), F.substring(F.col("given"), F.lit(1), i))), F.transform(_shorts(F.col("given")), lambda x: F.concat(F.lit("n"), x)))
    whole_tags = lambda of: of.filter(person & (F.col("form") == "full")).select("kind", "main", F.col("id").alias("b_id"), F.explode(tags).alias("tag"))
    by = F.when(F.col("form") == "nick", F.array(F.lit("n"))).when(F.col("form") == "initial", F.array(F.lit("p"))).otherwise(F.array(F.lit("n"), F.lit("p")))
    part_tags = lambda of: of.filter(person & (F.col("form") != "full")).select("kind", "main", F.col("id").alias("a_id"), "given", F.explode(by).alias("t")).select("kind", "main", "a_id", F.concat("t", "given").alias("tag"))
    fits = F.array_contains(_shorts(F.col("b_given")), F.col("a_given")) & (F.col("a_form") != "initial") | F.col("b_given").startswith(F.col("a_given")) & (F.col("a_form") != "nick")
    typed = lambda of: ways(slips, of).filter(_typo("a_main", "b_main") & (F.col("a_main") != F.col("b_main")))
    led = part_tags(keys).join(whole_tags(keys), ["kind", "main", "tag"]).select("a_id").unionByName(typed(keys.filter(person)).filter((F.col("b_form") == "full") & (F.col("a_form") == "nick") & fits).select("a_id")).distinct()
    keys = cut(keys.join(led.select(F.col("a_id").alias("id"), F.lit(True).alias("led")), "id", "left").withColumn("form", F.when((F.col("form") == "nick") & F.col("led").isNull(), "full").otherwise(F.col("form"))).drop("led"))
    fuzzy = cut(typed(keys))
    # full readings: a follows b if b is better attested
    better = (F.col("b_strings") > F.col("a_strings")) | ((F.col("b_strings") == F.col("a_strings")) & ((F.col("b_n") > F.col("a_n")) | ((F.col("b_n") == F.col("a_n")) & (F.col("b_id") < F.col("a_id")))))
    whole = (F.col("a_form") == "full") & (F.col("b_form") == "full")
    rare = (F.col("a_strings") <= 2) | (F.col("a_strings") * 3 <= F.col("b_strings"))
    family = keys.filter(person & (F.col("form") == "full") & (F.length("given") > 2)).select("id", F.concat_ws(" ", "kind", "main").alias("block"), F.col("given").alias("main"))
    given = ways(segment_join(family, k), keys).filter(_typo("a_given", "b_given") & (F.col("a_given") != F.col("b_given")))
    followed = (
        fuzzy.filter(whole & rare & better & (F.col("a_given") == F.col("b_given")))
        .unionByName(given.filter(rare & better & (F.length("a_given") > 3)))
        .groupBy("a_id").agg(F.max_by("b_id", F.struct("b_strings", "b_n", "b_id")).alias("up"))
    )
    root = _closed(keys.filter("form = 'full'").select("id").join(followed, F.col("id") == F.col("a_id"), "left").select("id", F.coalesce("up", "id").alias("root")))
    full = root.select(F.col("id").alias("b_id"), "root")
    exact = part_tags(keys).join(whole_tags(keys), ["kind", "main", "tag"]).join(full, "b_id").select("a_id", "root", F.lit(0).alias("far"))
    loose = fuzzy.filter((F.col("a_form") != "full") & (F.col("b_form") == "full") & fits).join(full, "b_id").select("a_id", "root", F.lit(1).alias("far"))
    fitting = exact.unionByName(loose).distinct()
    least = fitting.groupBy("a_id").agg(F.min("far").alias("far"))
    chosen = cut(fitting.join(least, ["a_id", "far"]).groupBy("a_id").agg(F.count(F.lit(1)).alias("k"), F.min("root").alias("root")))
    attached = chosen.filter("k = 1").select(F.col("a_id").alias("id"), "root")
    # initials and short forms that fit no full name follow a better attested one of their own kind
    lone = keys.filter("form <> 'full'").select("id").join(chosen.select(F.col("a_id").alias("id")), "id", "left_anti").select(F.col("id").alias("a_id"))
    partly = fuzzy.filter((F.col("a_form") == F.col("b_form")) & (F.col("a_form") != "full") & (F.col("a_given") == F.col("b_given")) & better)
    lonely = partly.join(lone, "a_id").join(attached.unionByName(keys.filter("form <> 'full'").join(attached, "id", "left_anti").select("id", F.col("id").alias("root"))).withColumnRenamed("id", "b_id"), "b_id")
    lonely = lonely.groupBy("a_id").agg(F.max_by("root", F.struct("b_strings", "b_n", "b_id")).alias("root")).select(F.col("a_id").alias("id"), "root")
    solved = root.unionByName(attached).unionByName(lonely)
    done = named.select("name", "id").join(solved, "id", "left").select("name", F.coalesce("root", "id").alias("entity"))
    return done


def pairs(linked: DataFrame) -> DataFrame:
    """``(name_a, name_b)``: each two spellings of one entity, the smaller in byte order first."""
    a, b = linked.select(F.col("name").alias("name_a"), "entity"), linked.select(F.col("name").alias("name_b"), "entity")
    return a.join(b, "entity").filter(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
