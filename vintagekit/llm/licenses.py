"""License scan by ordered signature rules, in DataFrame functions only.

The text is lowered (A-Z), cut into words and joined by single spaces. A rule runs if one of its keywords
occurs; the keywords cover every branch of its expression, so no match is lost. A rule is a regular expression over whole words with a priority: a notice ("licensed under the
...") or SPDX line before an address before a bare name before a vague mention. Detections are
word intervals; one that lies inside an interval of the same or a better priority is suppressed. They
are sorted by start (longer first) and folded once with the furthest end seen per priority, so
a document full of license names costs linear time and no pair is formed. Of equal intervals of one priority the first label
of the alphabet stands.

Base phrases are rules that cannot be suppressed. ``score`` is the confidence of the best detection
that stays: base phrase 1, notice or SPDX 0.95, address 0.9, name 0.7, mention 0.4, none 0.

Everything happens within a row: no shuffle, no join, so no group can be hot. Cases: null and empty
texts have no words and no labels (empty strings, score 0); repeated rows repeat; an empty table gives an
empty table; very long texts are scanned whole (memory follows the longest text); only id and text
are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagekit.llm.common import NON_WORD, ascii_lower, let

#: Base phrases and their labels. Fixed values.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label, keyword, name, SPDX words, address. Hand-written signatures over normalised words.
LICENSES = (
    ("mit", " mit ", r"(?:the )?mit licen[cs]e", "mit", "opensource org licenses mit"),
    ("mit-0", " mit ", r"mit no attribution(?: licen[cs]e)?", "mit 0", "opensource org licenses mit 0"),
    ("x11", " x11 ", r"x11 licen[cs]e", "x11", "x org downloads license"),
    ("isc", " isc ", r"isc licen[cs]e", "isc", "opensource org licenses isc"),
    ("apache-1.1", " apache ", r"apache (?:software )?licen[cs]e (?:version )?1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("apache-2", " apache ", r"apache (?:software )?licen[cs]e(?: version)? 2(?: 0)?", "apache 2 0", "apache org licenses license 2 0"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd)(?: licen[cs]e)?", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", " bsd ", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: licen[cs]e)?", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", " bsd ", r"(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?", "bsd 4 clause", "directory fsf org wiki license bsd 4clause"),
    ("0bsd", "0bsd", r"(?:0bsd|zero clause bsd)(?: licen[cs]e)?", "0bsd", "opensource org licenses 0bsd"),
    ("gpl-1", "g", r"(?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v)? ?1(?: 0)?", "gpl 1 0(?: only| or later)?", "gnu org licenses (?:old licenses )?gpl 1 0"),
    ("gpl-2", "g", r"(?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v)? ?2(?: 0)?", "gpl 2 0(?: only| or later)?", "gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3", "g", r"(?:gnu )?(?:general public licen[cs]e|gpl)(?: version| v)? ?3(?: 0)?", "gpl 3 0(?: only| or later)?", "gnu org licenses gpl 3 0"),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", "gpl", "gnu org (?:licenses gpl|copyleft gpl)"),
    ("lgpl-2", "l", r"(?:gnu )?(?:library general public licen[cs]e|lgpl)(?: version| v)? ?2(?: 0)?", "lgpl 2 0(?: only| or later)?", "gnu org licenses (?:old licenses )?lgpl 2 0"),
    ("lgpl-2.1", "l", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version| v)? ?2 1", "lgpl 2 1(?: only| or later)?", "gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3", "l", r"(?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version| v)? ?3(?: 0)?", "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0"),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public licen[cs]e", "lgpl", "gnu org (?:licenses lgpl|copyleft lesser)"),
    ("agpl-3", "a", r"(?:gnu )?(?:affero general public licen[cs]e|agpl)(?: version| v)? ?3(?: 0)?", "agpl 3 0(?: only| or later)?", "gnu org licenses agpl 3 0"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", "agpl", "gnu org licenses agpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[cs]e(?: version 1 [123])?", "gfdl(?: 1 [123])?(?: only| or later)?", "gnu org licenses fdl"),
    ("mpl-1.1", " mozilla ", r"mozilla public licen[cs]e (?:version )?1 [01]", "mpl 1 [01]", "mozilla org mpl (?:mpl )?1 [01]"),
    ("mpl-2", " mozilla ", r"mozilla public licen[cs]e(?: version| v)? 2(?: 0)?", "mpl 2 0", "mozilla org (?:en us )?mpl 2 0"),
    ("epl-1", " eclipse ", r"eclipse public licen[cs]e (?:version |v )?1(?: 0)?", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2", " eclipse ", r"eclipse public licen[cs]e (?:version |v )?2(?: 0)?", "epl 2 0", "eclipse org legal epl (?:v20|2 0)"),
    ("edl", " eclipse ", r"eclipse distribution licen[cs]e(?: version| v)?(?: 1(?: 0)?)?", "edl 1 0", "eclipse org org documents edl v10"),
    ("cddl", "common development", r"common development and distribution licen[cs]e(?: version)?(?: 1 [01])?", "cddl 1 [01]", "opensource org licenses cddl"),
    ("cpl-1", "common public", r"common public licen[cs]e(?: version)?(?: 1(?: 0)?)?", "cpl 1 0", "opensource org licenses cpl1 0"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e", "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e", "ms rl", "opensource org licenses ms rl"),
    ("artistic-1", " artistic ", r"artistic licen[cs]e(?: version)? 1(?: 0)?", "artistic 1 0", "opensource org licenses artistic license 1 0"),
    ("artistic-2", " artistic ", r"artistic licen[cs]e(?: version)? 2(?: 0)?", "artistic 2 0", "opensource org licenses artistic license 2 0"),
    ("boost-1", " boost ", r"boost software licen[cs]e(?: version)?(?: 1(?: 0)?)?", "bsl 1 0", "boost org license 1 0"),
    ("zlib", " zlib ", r"zlib(?: libpng)? licen[cs]e", "zlib", "opensource org licenses zlib"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "wtfpl", r"wtfpl(?: licen[cs]e)?", "wtfpl", "wtfpl net"),
    ("psf-2", " python ", r"python software foundation licen[cs]e(?: version)?(?: 2)?", "psf 2 0", "python org psf license"),
    ("php-3", " php ", r"php licen[cs]e(?: version)?(?: 3(?: 01?)?)?", "php 3 01?", "php net license"),
    ("postgresql", " postgresql ", r"postgresql licen[cs]e", "postgresql", "opensource org licenses postgresql"),
    ("openssl", " openssl ", r"openssl licen[cs]e", "openssl", "openssl org source license"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[cs]e(?: version)?(?: 1 1)?", "ofl 1 1", "scripts sil org ofl"),
    ("eupl", "european union public", r"european union public licen[cs]e(?: version| v)?(?: 1 [012])?", "eupl 1 [012]", "joinup ec europa eu .{0,40}eupl"),
    ("odbl", "open database", r"open database licen[cs]e(?: version| v)?(?: 1(?: 0)?)?", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("cc0", "c", r"(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?", "cc0 1 0", "creativecommons org publicdomain zero"),
    ("cc-by-nc-nd", "c", r"(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?derivatives?)(?: [1-4] 0)?", "cc by nc nd [1-4] 0", "creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa", "c", r"(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)(?: [1-4] 0)?", "cc by nc sa [1-4] 0", "creativecommons org licenses by nc sa"),
    ("cc-by-nc", "c", r"(?:cc|creative commons) (?:by nc|attribution non ?commercial)(?: [1-4] 0)?", "cc by nc [1-4] 0", "creativecommons org licenses by nc"),
    ("cc-by-nd", "c", r"(?:cc|creative commons) (?:by nd|attribution no ?derivatives?)(?: [1-4] 0)?", "cc by nd [1-4] 0", "creativecommons org licenses by nd"),
    ("cc-by-sa", "c", r"(?:cc|creative commons) (?:by sa|attribution share ?alike)(?: [1-4] 0)?", "cc by sa [1-4] 0", "creativecommons org licenses by sa"),
    ("cc-by", "c", r"(?:cc by|creative commons attribution)(?: [1-4] 0)?", "cc by [1-4] 0", "creativecommons org licenses by"),
)
#: Keywords above that stand for several: any of the words given here switches the rule on.
FAMILIES = {"g": ("general public", "gpl"), "l": ("lgpl", "lesser general", "library general"),
            "a": ("agpl", "affero"), "c": (" cc by", " cc attribution", " cc0 ", "creative commons", "creativecommons"),
            "bsd": (" bsd ", "freebsd"), "0bsd": ("0bsd", "zero clause bsd")}
SPDX = "spdx license identifier"
GENERIC = (
    ("public-domain", "public domain", r"(?:released into|dedicated to|placed in|in) the public domain"),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"proprietary (?:software )?licen[cs]e"),
    ("commercial", "commercial licen", r"commercial licen[cs]e(?: agreement)?"),
    ("eula", "licen", r"end user licen[cs]e agreement"),
)
_AS_PUBLISHED = r" as published by the free software foundation (?:either )?version "
#: Bodies, notices and short forms, each written by hand: label, priority, keyword, expression.
TEXTS = (
    ("mit", 1, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", 1, "permission to use copy modify", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-3-clause", 1, "endorse or promote", r"may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 1, "all advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", 1, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("zlib", 1, "as is without any express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", 1, "unencumbered software", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", 1, "what the fuck", r"do what the fuck you want to public licen[cs]e"),
    ("apache-2", 1, "apache licen", r"licensed under the apache license version 2 0 the license"),
    ("mpl-2", 1, "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e v(?:ersion)? 2 0"),
    ("epl-2", 1, "eclipse public", r"under the terms of the eclipse public licen[cs]e v(?:ersion )? ?2 0"),
    ("gpl-2", 1, "general public", r"gnu general public licen[cs]e" + _AS_PUBLISHED + "2"),
    ("gpl-3", 1, "general public", r"gnu general public licen[cs]e" + _AS_PUBLISHED + "3"),
    ("lgpl-2", 1, "general public", r"gnu library general public licen[cs]e" + _AS_PUBLISHED + "2"),
    ("lgpl-2.1", 1, "general public", r"gnu lesser general public licen[cs]e" + _AS_PUBLISHED + "2 1"),
    ("lgpl-3", 1, "general public", r"gnu lesser general public licen[cs]e" + _AS_PUBLISHED + "3"),
    ("agpl-3", 1, "affero", r"gnu affero general public licen[cs]e" + _AS_PUBLISHED + "3"),
    ("gpl-2", 3, "gplv2", r"gplv2(?: 0)?(?: only| or later)?"),
    ("gpl-3", 3, "gplv3", r"gplv3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", 3, "lgplv2 1", r"lgplv2 1(?: only| or later)?"),
    ("lgpl-3", 3, "lgplv3", r"lgplv3(?: 0)?(?: only| or later)?"),
    ("agpl-3", 3, "agplv3", r"agplv3(?: 0)?(?: only| or later)?"),
    ("busl-1.1", 3, "business source", r"business source licen[cs]e(?: version)?(?: 1 1)?"),
    ("busl-1.1", 1, SPDX, SPDX + r" busl 1 1"),
    ("sspl-1", 3, "server side public", r"server side public licen[cs]e(?: version| v)?(?: 1)?"),
    ("elastic-2", 3, "elastic licen", r"elastic licen[cs]e(?: version)?(?: 2(?: 0)?)?"),
    ("mit", 2, " mit ", r"mit (?:or|and) apache"),
    ("apache-2", 3, " mit ", r"mit (?:or|and) apache(?: licen[cs]e)?(?: version)? ?2(?: 0)?"),
    ("apache-2", 2, "apache", r"apache(?: licen[cs]e)?(?: version)? 2(?: 0)? (?:or|and)"),
    ("mit", 3, "apache", r"apache(?: licen[cs]e)?(?: version)? 2(?: 0)? (?:or|and) mit"),
    ("mit", 2, "opensource org license mit", r"(?:https? )?opensource org license mit"),
    ("bsd-2-clause", 2, "opensource org license bsd 2", r"(?:https? )?opensource org license bsd 2 clause"),
    ("bsd-3-clause", 2, "opensource org license bsd 3", r"(?:https? )?opensource org license bsd 3 clause"),
    ("apache-2", 2, "opensource org license apache", r"(?:https? )?opensource org license apache 2 0"),
    ("gpl-3", 2, "opensource org license gpl", r"(?:https? )?opensource org license gpl 3 0"),
    ("isc", 2, "opensource org license isc", r"(?:https? )?opensource org license isc(?: license txt)?"),
)
_GRANT = (r"(?:licen[cs]ed|released|distributed|available|provided|published|issued|shared) under "
          r"(?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:a )?")
CONFIDENCE = (1.0, 0.95, 0.9, 0.7, 0.4)  # by priority: base, notice or SPDX, address, name, mention


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, regular expression over whole words), in order."""
    out = [(label, 0, phrase, phrase) for phrase, label in BASE]
    for label, key, name, spdx, address in LICENSES:
        out += [(label, 1, key, _GRANT + name), (label, 1, SPDX, f"{SPDX} {spdx}"),
                (label, 2, key if key in FAMILIES else address.split("(")[0].split(".")[0], "(?:https? )?(?:www )?" + address), (label, 3, key, name)]
        out.append((label, 2, SPDX, f"{SPDX} (?:.{{0,80}} )?(?:or|and|with) {spdx}"))  # the last part of an expression
    out += TEXTS
    out += [(label, 4, key, name) for label, key, name in GENERIC]
    return [(label, p, key, f"(?<= )(?:{rx})(?= )") for label, p, key, rx in out]


def normalised(text: Column) -> Column:
    """The words joined by single spaces, a space before and after; a single space if there are none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(text), NON_WORD, " ")), F.lit(" "))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


#: Marks around a match; words hold no control characters.
_OPEN, _CLOSE = "\x01", "\x02"
_DETECTION = "array<struct<start:int,stop:int,priority:int,label:string>>"


def _places(norm: Column, rule: Column) -> Column:
    """Word intervals of all matches of a rule: the matches are marked in the text, and the marked words' numbers are
    where they start and stop. Linear in the text, however many matches there are."""
    def numbers(words: Column, marked) -> Column:
        return F.filter(F.transform(words, lambda w, i: F.when(marked(w), i)), lambda i: i.isNotNull())

    def walk(words: Column) -> Column:
        return F.zip_with(numbers(words, lambda w: F.startswith(w, F.lit(_OPEN))), numbers(words, lambda w: F.endswith(w, F.lit(_CLOSE))),
                          lambda a, b: F.struct(a.alias("start"), (b + 1).alias("stop"), rule["priority"].alias("priority"), rule["label"].alias("label")))

    return let(F.regexp_replace(norm, rule["rx"], F.lit(f"{_OPEN}$0{_CLOSE}")), lambda t: F.when(
        F.contains(t, F.lit(_OPEN)), let(F.split(F.trim(t), " ", -1), walk)).otherwise(F.array().cast(_DETECTION)))


def detections(norm: Column) -> Column:
    """All matches of all rules whose keyword occurs, before suppression."""
    table = rules()
    switch = {k: (k,) for _, _, k, _ in table if k not in FAMILIES} | FAMILIES
    by_key: dict[str, list] = {}
    for label, priority, key, rx in table:
        by_key.setdefault(key, []).append((label, priority, rx))
    groups = F.array(*[F.struct(
        F.array(*[F.lit(w) for w in switch[key]]).alias("keys"),
        F.array(*[F.struct(F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(rx).alias("rx")) for label, p, rx in rs]).alias("rules"))
        for key, rs in by_key.items()])
    wanted = F.flatten(F.transform(F.filter(groups, lambda g: F.exists(g["keys"], lambda k: F.contains(norm, k))), lambda g: g["rules"]))
    return F.flatten(F.transform(wanted, lambda r: _places(norm, r)))


def _standing(found: Column) -> Column:
    """(label, priority) of the detections that are not inside one of the same or a better
    priority; base phrases always stay. One fold over the detections by start, longer first."""
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(
        d["start"].alias("start"), (-d["stop"]).alias("back"), d["priority"].alias("priority"), d["label"].alias("label"))))
    levels = len(CONFIDENCE)

    def step(s: Column, d: Column) -> Column:
        stop = -d["back"]
        reach = F.lit(-1)
        for p in range(levels):
            reach = F.greatest(reach, F.when(d["priority"] >= p, s[f"end{p}"]).otherwise(F.lit(-1)))
        stands = (d["priority"] == 0) | (reach < stop)
        ends = [F.when((d["priority"] == p) & (s[f"end{p}"] < stop), stop).otherwise(s[f"end{p}"]).alias(f"end{p}") for p in range(levels)]
        one = F.array(F.struct(d["label"].alias("label"), d["priority"].alias("priority")))
        return F.struct(*ends, F.when(stands, F.array_union(s["out"], one)).otherwise(s["out"]).alias("out"))

    start = F.struct(*[F.lit(-1).alias(f"end{p}") for p in range(levels)], F.array().cast("array<struct<label:string,priority:int>>").alias("out"))
    return F.aggregate(ordered, start, step)["out"]


def license_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    n_words = F.when(F.col("norm") == "  ", F.lit(0)).otherwise(_spaces(F.col("norm")) - 1).cast("long")
    found = norm.select("doc_id", n_words.alias("n_words"), detections(F.col("norm")).alias("found"))
    found = found.select("doc_id", "n_words", F.filter("found", lambda d: d["priority"] == 0).alias("base"), _standing(F.col("found")).alias("stand"))
    base, stand = F.col("base"), F.col("stand")
    label = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda d: d["label"]))), ",")
    score = F.lit(0.0)
    for p, c in reversed(list(enumerate(CONFIDENCE))):
        score = F.when(F.array_contains(F.transform(stand, lambda d: d["priority"]), p), F.lit(c)).otherwise(score)
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["start"])).cast("long").alias("last_word"),
        label(base).alias("base_labels"), label(stand).alias("labels"), score.alias("score"))
