"""License scans: ordered signature rules behind a keyword prefilter.

A rule is a regex over normalised words with a keyword, `back` words after its start. Rules
are license names, what grants them, SPDX lines, and signatures of license texts (written by
hand in `license_signatures`). One pass looks up each word among the keywords; only there
are the rules of that keyword tried, on as many words as the rule can reach, so nothing cuts
a match. Where detections overlap, one that lies inside another of the same or a higher
priority is suppressed; base phrases always stay and suppress nothing. Only DataFrame
operations are used.

score: the largest confidence among the detections that stay; 0 without any.

Defined results: null and wordless texts have no detections, null places, empty labels and
score 0; repeated rows are scanned apart; columns besides id and text may have any name.
"""

from __future__ import annotations

import re
from re import _parser as regex_parser

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .license_signatures import SIGNATURES
from .words import scan, slice_text

#: Priorities: a full notice outranks a named grant, which outranks a bare name.
NAME, GRANT, NOTICE = 1, 2, 3

# Fixed phrases and labels of the base scan: phrase, label.
BASE_PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]

_V = r"(?: ?(?:version|v|ver))?"
_LATER = r"(?: or (?:any )?later(?: version)?)?"
_CC = r"(?:cc|creative commons(?: attribution)?)"

#: Label, its name as a regex over words, the words that the name can start with, and whether the bare name counts.
FAMILIES = [
    ("apache-2.0", rf"apache (?:software )?license{_V} 2(?: 0)?", "apache", True),
    ("apache-1.1", rf"apache (?:software )?license{_V} 1 1", "apache", True),
    ("apache-1.0", rf"apache (?:software )?license{_V} 1 0", "apache", True),
    ("mit", r"(?:mit|expat|x11) license", "mit expat x11", True),
    ("mit-0", r"mit no attribution(?: license)?", "mit", True),
    ("isc", r"isc license", "isc", True),
    ("gpl-3.0", rf"(?:gnu )?(?:general public license|gpl){_V} ?3(?: 0)?{_LATER}", "gnu general gpl gplv3", True),
    ("gpl-2.0", rf"(?:gnu )?(?:general public license|gpl){_V} ?2(?: 0)?{_LATER}", "gnu general gpl gplv2", True),
    ("gpl-1.0", rf"(?:gnu )?(?:general public license|gpl){_V} ?1(?: 0)?{_LATER}", "gnu general gpl gplv1", True),
    ("lgpl-3.0", rf"(?:gnu )?(?:lesser general public license|lgpl){_V} ?3(?: 0)?{_LATER}", "gnu lesser lgpl lgplv3", True),
    ("lgpl-2.1", rf"(?:gnu )?(?:lesser general public license|lgpl){_V} ?2 1{_LATER}", "gnu lesser lgpl", True),
    ("lgpl-2.0", rf"(?:gnu )?(?:library general public license|lgpl){_V} ?2(?: 0)?{_LATER}", "gnu library lgpl", True),
    ("agpl-3.0", rf"(?:gnu )?(?:affero general public license|agpl){_V} ?3(?: 0)?{_LATER}", "gnu affero agpl agplv3", True),
    ("gfdl-1.3", rf"(?:gnu )?(?:free documentation license|gfdl|fdl){_V} 1 3", "gnu free gfdl fdl", True),
    ("gfdl-1.2", rf"(?:gnu )?(?:free documentation license|gfdl|fdl){_V} 1 2", "gnu free gfdl fdl", True),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?", "bsd 2 simplified freebsd", True),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: license)?", "bsd 3 new modified", True),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?", "bsd 4 original", True),
    ("0bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)(?: license)?", "0bsd zero bsd", True),
    ("mpl-2.0", rf"(?:mozilla public license|mpl){_V} 2(?: 0)?", "mozilla mpl", True),
    ("mpl-1.1", rf"(?:mozilla public license|mpl){_V} 1 1", "mozilla mpl", True),
    ("epl-2.0", rf"(?:eclipse public license|epl){_V} 2(?: 0)?", "eclipse epl", True),
    ("epl-1.0", rf"(?:eclipse public license|epl){_V} 1(?: 0)?", "eclipse epl", True),
    ("eupl-1.2", rf"(?:european union public licen[cs]e|eupl){_V} 1 2", "european eupl", True),
    ("eupl-1.1", rf"(?:european union public licen[cs]e|eupl){_V} 1 1", "european eupl", True),
    ("cddl-1.0", rf"(?:common development and distribution license|cddl){_V} 1(?: 0)?", "common cddl", True),
    ("cpl-1.0", rf"common public license{_V} 1 0", "common", True),
    ("artistic-2.0", rf"artistic license{_V} 2(?: 0)?", "artistic", True),
    ("artistic-1.0", rf"artistic license{_V} 1(?: 0)?", "artistic", True),
    ("bsl-1.0", rf"boost software license{_V} 1(?: 0)?", "boost", True),
    ("zlib", r"zlib(?: libpng)? license", "zlib", True),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public license)", "wtfpl do", True),
    ("unlicense", r"(?:the )?unlicense", "unlicense", True),
    ("ofl-1.1", rf"(?:sil )?open font license{_V} 1 1", "sil open", True),
    ("odbl-1.0", r"(?:open database license|odbl)(?: v?1 0)?", "open odbl", True),
    ("odc-by-1.0", r"(?:open data commons attribution license|odc by)(?: v?1 0)?", "open odc", True),
    ("pddl-1.0", r"(?:public domain dedication and license|pddl)(?: v?1 0)?", "public pddl", True),
    ("psf-2.0", rf"(?:python software foundation license|psf license){_V}(?: 2)?", "python psf", True),
    ("postgresql", r"postgresql licen[cs]e", "postgresql", True),
    ("openssl", r"openssl license", "openssl", True),
    ("ncsa", r"(?:university of illinois )?ncsa open source license", "university ncsa", True),
    ("ms-pl", r"(?:microsoft public license|ms pl)", "microsoft ms", True),
    ("ms-rl", r"(?:microsoft reciprocal license|ms rl)", "microsoft ms", True),
    ("afl-3.0", rf"(?:academic free license|afl){_V} 3(?: 0)?", "academic afl", True),
    ("osl-3.0", rf"(?:open software license|osl){_V} 3(?: 0)?", "open osl", True),
    ("elastic-2.0", rf"elastic license{_V} 2(?: 0)?", "elastic", True),
    ("sspl-1.0", rf"(?:server side public license|sspl){_V}(?: 1(?: 0)?)?", "server sspl", True),
    ("busl-1.1", rf"(?:business source license|busl){_V}(?: 1 1)?", "business busl", True),
    ("cc0-1.0", r"(?:cc0|cc zero|creative commons zero)(?: 1 0)?(?: universal)?", "cc0 cc creative", True),
    *[
        (f"cc-by{part}-{major}.{minor}", rf"{_CC} by{words} {major} {minor}", "cc creative", True)
        for part, words in (("", ""), ("-sa", " sa"), ("-nd", " nd"), ("-nc", " nc"), ("-nc-sa", " nc sa"), ("-nc-nd", " nc nd"))
        for major, minor in ((4, 0), (3, 0), (2, 5), (2, 0))
    ],
    ("public-domain", r"public domain", "public", True),
    ("gpl", r"(?:gnu )?general public license", "gnu general", False),
    ("bsd", r"bsd(?: style)? license", "bsd", True),
    ("proprietary", r"(?:proprietary|commercial|end user)(?: software)? license(?: agreement)?", "proprietary commercial end", True),
]

#: Grants: what stands before a family's name, its keyword.
GRANTS = [
    (r"licensed (?:to you )?under (?:the )?(?:terms of (?:the )?)?(?:gnu )?", "licensed"),
    (r"released (?:as is )?under (?:the )?(?:terms of (?:the )?)?(?:gnu )?", "released"),
    (r"distributed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?", "distributed"),
    (r"available under (?:the )?(?:terms of (?:the )?)?(?:gnu )?", "available"),
]

#: Confidences: of a base phrase, a name, a grant, a license text, an SPDX line.
SURE = {"base": 0.5, "name": 0.6, "grant": 0.9, "text": 0.95, "spdx": 1.0}


def reach(regex: str) -> int:
    """How many words a regex over single-spaced words can match, at most; an error if there is no end to it."""

    def blanks(parsed) -> int:  # noqa: ANN001
        total = 0
        for op, value in parsed:
            name = str(op)
            if name == "LITERAL":
                total += value == 32
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                inner = blanks(value[2])
                if inner and value[1] is regex_parser.MAXREPEAT:
                    raise ValueError(f"no end to {regex}")
                total += inner and inner * value[1]
            elif name == "BRANCH":
                total += max(blanks(b) for b in value[1])
            elif name == "SUBPATTERN":
                total += blanks(value[3])
        return total

    return blanks(regex_parser.parse(regex)) + 1


def keyword(regex: str) -> tuple[str, int]:
    """The longest of the plain words that a signature begins with, and its place."""
    front = []
    for word in regex.split(" "):
        if not word.isalnum():
            break
        front.append(word)
    best = max(front, key=len)
    return best, front.index(best)


def rules() -> list[tuple[str, int, str, str, int, float, bool]]:
    """keyword, back, regex, label, priority, confidence, is_base; some hundreds."""
    found = [(p.split()[0], 0, p, label, 0, SURE["base"], True) for p, label in BASE_PHRASES]
    for label, name, starts, bare in FAMILIES:
        if bare:
            found += [(w, 0, name, label, NAME, SURE["name"], False) for w in starts.split()]
        found += [(word, 0, before + f"(?:{name})", label, GRANT, SURE["grant"], False) for before, word in GRANTS]
        spdx = label.replace("-", " ").replace(".", " ")
        found.append(("spdx", 0, rf"spdx license identifier {spdx}(?: only| or later)?", label, NOTICE, SURE["spdx"], False))
    for label, regex in SIGNATURES:
        for one in re.split(r"\|(?![^(]*\))", regex):
            word, back = keyword(one)
            found.append((word, back, one, label, NOTICE, SURE["text"], False))
    return found


def rule_table(spark: SparkSession) -> DataFrame:
    schema = "anchor string, back int, reach int, regex string, label string, priority int, confidence double, is_base boolean"
    rows = [(k, back, reach(rx), rf"^(?:{rx})(?![^ ])", *rest) for k, back, rx, *rest in rules()]
    return spark.createDataFrame(rows, schema)


def detect(docs: DataFrame) -> DataFrame:
    """A row for each detection, suppressed ones too, and one marker row (null label) for each row of docs."""
    found = scan(docs, rule_table(docs.sparkSession))
    start = F.col("at") - F.col("back")
    text = F.when(start >= 0, F.regexp_substr(slice_text(F.col("words"), start, F.col("reach")), F.col("regex")))
    found = found.withColumn("_match", text).where(F.col("at").isNull() | F.col("_match").isNotNull()).select(
        "_row", "id", "n_words", "label", "priority", "confidence", "is_base", start.alias("start"),
        (start + F.size(F.split("_match", " "))).alias("end"),
    )
    # Sorted so that a container comes first; the furthest end so far of each priority says what is contained.
    before = (
        Window.partitionBy("_row").orderBy("start", F.desc("end"), F.desc("priority"), "label")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    reach = lambda p: F.coalesce(F.max(F.when(F.col("priority") >= p, F.col("end"))).over(before) >= F.col("end"), F.lit(False))
    inside = F.when(F.col("priority") == NAME, reach(NAME)).when(F.col("priority") == GRANT, reach(GRANT)).when(
        F.col("priority") == NOTICE, reach(NOTICE)
    )
    return found.withColumn("suppressed", F.coalesce(inside, F.lit(False)))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: id, n_words, base places and labels, all labels, score."""
    base, stays = F.col("is_base"), F.col("label").isNotNull() & ~F.col("suppressed")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return detect(docs).groupBy("_row", "id").agg(
        F.max("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(stays, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(stays, F.col("confidence"))), F.lit(0.0)).alias("score"),
    )


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_licenses(docs).drop("_row").withColumnRenamed("id", "doc_id")
