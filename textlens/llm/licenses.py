"""License scans by sentence rules.

Sentences are normalised and mapped to the identifiers of known licence sentences;
a document's identifier sequence is then matched against ordered rules. Everything
is one projection over the text: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifier and pattern of known licence sentences. Patterns match a
# whole normalised sentence (lower case, every run of other characters one space) or
# whole lines of it; the first in the list takes the lines.
SENTENCES = [
    ("ApacheRef", r"(this (file|work|software|project|program) is )?(licensed|released|distributed) under (the )?(terms of )?(the )?apache (software )?license(,? version)? ?v?(2|2 0)( the license)?"),
    ("ApacheNoUse", r"you may not use this file except in compliance with the license"),
    ("ApacheCopy", r"you may obtain a copy of the license at( http(s)? www apache org licenses license 2 0)?"),
    ("AsIsBasis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("MITRef", r"(this (file|work|software|project|program) is )?(licensed|released|distributed|available) under (the )?(terms of )?(the )?mit license"),
    ("MITGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files.*"),
    ("MITNotice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("AsIsMIT", r"the software is provided as is without warranty of any kind express or implied.*"),
    ("GPL3OrLater", r"(this (file|work|software|project|program) is )?(licensed|released|distributed) under (the )?(terms of )?(the )?(gnu )?(general public license|gpl),? ?(version |v)?3( 0)? or (at your option )?(any )?later( version)?"),
    ("GPL3Ref", r"(this (file|work|software|project|program) is )?(licensed|released|distributed) under (the )?(terms of )?(the )?(gnu )?(general public license|gpl),? ?(version |v)?3( 0)?( only)?"),
    ("GPL2OrLater", r"(this (file|work|software|project|program) is )?(licensed|released|distributed) under (the )?(terms of )?(the )?(gnu )?(general public license|gpl),? ?(version |v)?2( 0)? or (at your option )?(any )?later( version)?"),
    ("GPL2Ref", r"(this (file|work|software|project|program) is )?(licensed|released|distributed) under (the )?(terms of )?(the )?(gnu )?(general public license|gpl),? ?(version |v)?2( 0)?( only)?"),
    ("GPLFree", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation.*"),
    ("GPLNoWarranty", r"this program is distributed in the hope that it will be useful but without any warranty.*"),
    ("LGPL3OrLater", r"(this (file|work|software|project|program) is )?(licensed|released|distributed) under (the )?(gnu )?(lesser general public license|lgpl),? ?(version |v)?3( 0)? or (at your option )?(any )?later( version)?"),
    ("LGPL3Ref", r"(this (file|work|software|project|program) is )?(licensed|released|distributed) under (the )?(gnu )?(lesser general public license|lgpl),? ?(version |v)?3( 0)?"),
    ("AGPL3OrLater", r"(this (file|work|software|project|program) is )?(licensed|released|distributed) under (the )?(terms of )?(the )?(gnu )?(affero general public license|agpl),? ?(version |v)?3( 0)? or (at your option )?(any )?later( version)?"),
    ("AGPL3Ref", r"(this (file|work|software|project|program) is )?(licensed|released|distributed) under (the )?(terms of )?(the )?(gnu )?(affero general public license|agpl),? ?(version |v)?3( 0)?( only)?"),
    ("AGPLFree", r"this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license.*"),
    ("LGPLFree", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license.*"),
    ("LGPLNoWarranty", r"this library is distributed in the hope that it will be useful but without any warranty.*"),
    ("LGPL21OrLater", r"(this (file|work|library|software|project|program) is )?(licensed|released|distributed) under (the )?(gnu )?(lesser general public license|lgpl),? ?(version |v)?2 1 or (at your option )?(any )?later( version)?"),
    ("LGPL21Ref", r"(this (file|work|library|software|project|program) is )?(licensed|released|distributed) under (the )?(gnu )?(lesser general public license|lgpl),? ?(version |v)?2 1( only)?"),
    ("ISCGrant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISCDisclaim", r"the software is provided as is and the author disclaims all warranties.*"),
    ("ISCRef", r"(this (file|work|software|project|program) is )?(licensed|released|distributed|available) under (the )?(terms of )?(the )?isc license"),
    ("UnlicenseFree", r"this is free and unencumbered software released into the public domain"),
    ("BoostRef", r"(this (file|work|software|project|program) is )?(licensed|released|distributed|subject) (under|to) (the )?(terms of )?(the )?boost software license,? ?(version )?1 0"),
    ("ZlibMay", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely.*"),
    ("EPL2Ref", r"(this (file|work|software|project|program) is )?(licensed|released|made available|available|distributed) under (the )?(terms of )?(the )?eclipse public license,? ?(version |v)?2 0"),
    ("BSDRedistribution", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*"),
    ("BSDSource", r".*redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSDBinary", r".*redistributions in binary form must reproduce the above copyright notice.*"),
    ("BSDEndorse", r".*neither the name of .* may be used to endorse or promote products.*"),
    ("AsIsBSD", r"this software is provided by .* as is and any express or implied warranties.*"),
    ("BSDRef", r"(this (file|work|software|project|program) is )?(licensed|released|distributed) under (the )?(2|3|two|three) clause bsd license"),
    ("MPL2Ref", r"(this (file|work|software|source code form|project|program) is )?(licensed|released|subject) (under|to) (the )?terms of the mozilla public license,? ?(version |v ?)?2 0"),
    ("CCBYNC4", r"(this (file|work|software|project|text) is )?(licensed|released) under (a )?(the )?(cc by nc|creative commons attribution non ?commercial)( international)?( license)? 4 0( international)?( license)?"),
    ("CCBYSA4", r"(this (file|work|software|project|text) is )?(licensed|released) under (a )?(the )?(cc by sa|creative commons attribution share ?alike)( international)?( license)? 4 0( international)?( license)?"),
    ("CCBY4", r"(this (file|work|software|project|text) is )?(licensed|released) under (a )?(the )?(cc by|creative commons attribution)( international)?( license)? 4 0( international)?( license)?"),
    ("CC0", r"(this (file|work|software|project|text) is )?(licensed|released|dedicated) (under|to) (the )?(cc0|public domain).*"),
    ("SPDX", r"spdx license identifier .*"),
    ("AllRights", r"all rights reserved"),
]

# Licence and rule over the identifier sequence, tried in this order.
# A rule matches identifiers in sequence order, "~" allows others between, and takes
# what it matched: later rules read the rest.
RULES = [
    ("Apache-2.0", "ApacheNoUse~ApacheCopy"),
    ("Apache-2.0", "ApacheRef"),
    ("MIT", "MITGrant~MITNotice~AsIsMIT"),
    ("MIT", "MITRef"),
    ("GPL-3.0-or-later", "GPL3OrLater"),
    ("GPL-3.0", "GPL3Ref"),
    ("GPL-2.0-or-later", "GPL2OrLater"),
    ("GPL-2.0", "GPL2Ref"),
    ("GPL", "GPLFree~GPLNoWarranty"),
    ("LGPL-3.0-or-later", "LGPL3OrLater"),
    ("LGPL-3.0", "LGPL3Ref"),
    ("AGPL-3.0-or-later", "AGPL3OrLater"),
    ("AGPL-3.0", "AGPL3Ref"),
    ("AGPL", "AGPLFree"),
    ("LGPL", "LGPLFree~LGPLNoWarranty"),
    ("LGPL-2.1-or-later", "LGPL21OrLater"),
    ("LGPL-2.1", "LGPL21Ref"),
    ("ISC", "ISCGrant~ISCDisclaim"),
    ("ISC", "ISCRef"),
    ("Unlicense", "UnlicenseFree"),
    ("BSL-1.0", "BoostRef"),
    ("Zlib", "ZlibMay"),
    ("EPL-2.0", "EPL2Ref"),
    ("BSD-3-Clause", "BSDRedistribution~BSDSource~BSDBinary~BSDEndorse"),
    ("BSD-2-Clause", "BSDRedistribution~BSDSource~BSDBinary"),
    ("BSD", "BSDRef"),
    ("MPL-2.0", "MPL2Ref"),
    ("CC-BY-NC-4.0", "CCBYNC4"),
    ("CC-BY-SA-4.0", "CCBYSA4"),
    ("CC-BY-4.0", "CCBY4"),
    ("CC0-1.0", "CC0"),
]

#: Sentences that name a licence; a clause may follow, but not the rest of a version.
REFERENCE = r"Ref$|OrLater$|^CCBY"
CLAUSE = r"(?: (?!\d)[^\n<>]*)?"

#: A licence name, and the tag with its expression of names.
SPDX_NAME = r"[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
SPDX_TAG = rf"(?i)spdx-license-identifier:[ \t(]*({SPDX_NAME}(?:[ \t()]+(?:or|and|with)[ \t()]+{SPDX_NAME})*)"

#: A sentence ends at a blank line (one without letter or digit), after . ! ? ; before
#: white space (but for the v. of a version), or before an SPDX tag. A single line break with its comment marks is a space inside it.
SENTENCE_END = r"\n[^\p{L}\p{N}]*\n|(?<=[.!?;])(?<![\s,(][vV]\.)\s+|(?=(?i:spdx-license-identifier:))"
#: Line breaks with the comment words after them.
LINE_START = r"(?:^|\n)[^\p{L}\p{N}\n]*(?:(?:dnl|rem|c)(?![\p{L}\p{N}]))?"
#: Only sentences with one of these stems are tried against the patterns.
STEMS = r"licens|software|warrant|redistribut|conditions|copies|public domain|gpl|cc0|all rights reserved|products|(?:released|distributed|available|published)\s+under|cc[\s-]by|creative\s+commons"


def wrapped(name: str, pattern: str) -> str:
    """A pattern of SENTENCES for a sentence that still has its line breaks.

    It covers whole lines, as many as it needs: notices are wrapped anywhere, and
    lines without a full stop are sentences of their own. Open ends stay on their line.
    """
    head, tail = pattern.startswith(".*"), pattern.endswith(".*")
    inner = pattern[2 * head : len(pattern) - 2 * tail].replace(".*", "[^<>]*?").replace(" ", "[ \n]")
    line = "[^\n<>]*"
    end = CLAUSE if re.search(REFERENCE, name) else line * tail
    return f"(?<![^\n])(?:{line * head}(?:{inner}){end})(?![^\n])"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    breaks = F.translate(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    sentences = F.filter(F.split(breaks, SENTENCE_END), lambda s: F.lower(s).rlike(STEMS))

    def normal(s: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(F.lower(s), LINE_START, "\n"), r"[^\p{L}\p{N}\n]+", " ")
        return F.regexp_replace(F.regexp_replace(s, r" *\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")

    def known(s: Column) -> Column:
        for name, pattern in SENTENCES:
            s = F.regexp_replace(s, wrapped(name, pattern), f"<{name}>")
        return F.regexp_extract_all(s, F.lit("<([A-Za-z0-9]+)>"), F.lit(1))

    def tagged(s: Column) -> Column:
        return F.when(spdx(s) != "", F.array(F.concat(F.lit("SPDX:"), spdx(s)))).otherwise(F.array().cast("array<string>"))

    rest = F.transform(sentences, lambda s: normal(F.when(spdx(s) != "", F.regexp_replace(s, SPDX_TAG, "\n")).otherwise(s)))
    return F.flatten(F.zip_with(F.transform(sentences, tagged), F.transform(rest, known), lambda a, b: F.concat(a, b)))


def spdx(sentence: Column) -> Column:
    """Licence names of a sentence's SPDX tag, joined by |; empty without any.

    Exceptions (after WITH) are left out, ``-only`` goes, ``+`` is ``-or-later``; names
    that RULES has are spelled as there, others as written.
    """
    names = F.regexp_extract(sentence, SPDX_TAG, 1)
    names = F.regexp_replace(names, rf"(?i)[ \t()]+with[ \t()]+{SPDX_NAME}", "")
    names = F.regexp_replace(names, r"(?i)[ \t()]+(?:or|and)[ \t()]+", "|")
    names = F.regexp_replace(F.regexp_replace(names, r"(?i)-only(?=\||$)", ""), r"\+(?=\||$)", "-or-later")
    for name in dict(RULES):
        names = F.regexp_replace(names, rf"(?i)(?<![^|]){re.escape(name)}(?![^|])", name)
    return F.when(names.rlike(r"(?i)(?<![^|])(none|noassertion)(?![^|])"), F.lit("")).otherwise(names)


def rule_regex(rule: str) -> str:
    """A rule over ",id,id,"; groups hold what stands between its identifiers."""
    return ",(?:" + ",((?:[^,]+,)*?)".join(rule.split("~")) + "),"


def licenses_of(ids: Column) -> Column:
    """Licences whose rule the sequence matches, in rule order, then those of SPDX tags; no repeats."""
    rest = F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))
    hits = []
    for name, rule in RULES:
        hits.append(F.when(rest.rlike(rule_regex(rule)), F.lit(name)))
        between = "".join(f"${k}" for k in range(1, rule.count("~") + 1))
        rest = F.regexp_replace(rest, rule_regex(rule), f",{between}")
    found = F.array_compact(F.array(*hits))
    named = F.flatten(F.transform(F.filter(ids, lambda x: x.startswith("SPDX:")), lambda x: F.split(F.substring(x, 6, 1_000_000), r"\|")))
    return F.array_distinct(F.concat(found, named))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_sentences (known ones), sentence_ids and licenses (comma-joined strings).

    Null and empty texts have none. Every row gives a row, repeated ones too; known
    sentences that no rule covers leave licenses as ``unknown``; no column but the
    two named is read.
    """
    ids = docs.select(F.col(key), sentence_ids(F.col(text)).alias("ids"))
    none = F.array().cast("array<string>")
    found = ids.select(key, "ids", F.when(F.size("ids") > 0, licenses_of(F.col("ids"))).otherwise(none).alias("found"))
    return found.select(
        key,
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.when(F.size("found") > 0, F.array_join("found", ",")).when(F.size("ids") > 0, F.lit("unknown")).otherwise("").alias("licenses"),
    )
