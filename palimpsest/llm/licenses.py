"""License scans by ordered signature rules.

Each rule is a regex with a label, a priority and a keyword. A text is lower-cased and
searched for the keywords first; only the rules of keywords that it contains run. A space
in a rule stands for any white space, and comment marks after it, so notices that are
wrapped or commented out are found as well. A detection inside the span of one with a higher (or equal, but longer) priority is
suppressed. Apart from that the base phrases are found at places of consecutive words.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
_IN, _OUT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"

#: Licenses by hand: label, SPDX identifiers, names, and the address of the text. Regexes over lower-cased text.
LICENSES = [
    ("mit", r"mit(?:-0)?", r"(?:the )?mit(?:/x11)? licen[cs]e|(?:the )?expat licen[cs]e", r"opensource\.org/licen[cs]es/mit"),
    ("apache-2.0", r"apache-2\.0", r"apache licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?", r"apache\.org/licen[cs]es/licen[cs]e-2\.0"),
    ("apache-1.1", r"apache-1\.1", r"apache (?:software )?licen[cs]e,? (?:version |v\.? ?)?1\.1", r"apache\.org/licen[cs]es/licen[cs]e-1\.1"),
    ("gpl-2.0", r"gpl-2\.0(?:-only|-or-later|\+)?", r"(?:gnu )?general public licen[cs]e,? (?:version |v\.? ?)2(?:\.0)?|gplv2|gpl v?2(?:\.0)?", r"gnu\.org/licen[cs]es/(?:old-licen[cs]es/)?gpl-2\.0"),
    ("gpl-3.0", r"gpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?general public licen[cs]e,? (?:version |v\.? ?)3(?:\.0)?|gplv3|gpl v?3(?:\.0)?", r"gnu\.org/licen[cs]es/gpl-3\.0"),
    ("lgpl-2.1", r"lgpl-2\.[01](?:-only|-or-later|\+)?", r"(?:gnu )?(?:lesser|library) general public licen[cs]e,? (?:version |v\.? ?)2(?:\.[01])?|lgplv2(?:\.1)?", r"gnu\.org/licen[cs]es/(?:old-licen[cs]es/)?lgpl-2\.1"),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?lesser general public licen[cs]e,? (?:version |v\.? ?)3(?:\.0)?|lgplv3", r"gnu\.org/licen[cs]es/lgpl-3\.0"),
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later|\+)?", r"(?:gnu )?affero general public licen[cs]e(?:,? (?:version |v\.? ?)3(?:\.0)?)?|agplv3", r"gnu\.org/licen[cs]es/agpl-3\.0"),
    ("gfdl", r"gfdl-1\.[123](?:-only|-or-later|\+)?", r"(?:gnu )?free documentation licen[cs]e(?:,? (?:version |v\.? ?)1\.[123])?", r"gnu\.org/licen[cs]es/fdl"),
    ("bsd-2-clause", r"bsd-2-clause(?:-patent)?", r"(?:2|two)-clause bsd(?: licen[cs]e)?|simplified bsd licen[cs]e|freebsd licen[cs]e", r"opensource\.org/licen[cs]es/bsd-2-clause"),
    ("bsd-3-clause", r"bsd-3-clause(?:-clear)?", r"(?:3|three)-clause bsd(?: licen[cs]e)?|(?:new|modified|revised) bsd licen[cs]e", r"opensource\.org/licen[cs]es/bsd-3-clause"),
    ("bsd-4-clause", r"bsd-4-clause", r"(?:4|four)-clause bsd(?: licen[cs]e)?|original bsd licen[cs]e", r"spdx\.org/licen[cs]es/bsd-4-clause"),
    ("0bsd", r"0bsd", r"zero-clause bsd(?: licen[cs]e)?", r"opensource\.org/licen[cs]es/0bsd"),
    ("isc", r"isc", r"isc licen[cs]e", r"opensource\.org/licen[cs]es/isc"),
    ("mpl-1.1", r"mpl-1\.[01]", r"mozilla public licen[cs]e,? (?:version |v\.? ?)1\.[01]", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", r"mpl-2\.0", r"mozilla public licen[cs]e,? (?:version |v\.? ?)2(?:\.0)?", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("epl-1.0", r"epl-1\.0", r"eclipse public licen[cs]e,?(?: -)? (?:version |v\.? ?)1(?:\.0)?", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", r"epl-2\.0", r"eclipse public licen[cs]e,?(?: -)? (?:version |v\.? ?)2(?:\.0)?", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("cddl-1.0", r"cddl-1\.[01]", r"common development and distribution licen[cs]e", r"opensource\.org/licen[cs]es/cddl1"),
    ("cpl-1.0", r"cpl-1\.0", r"common public licen[cs]e", r"opensource\.org/licen[cs]es/cpl1\.0"),
    ("eupl", r"eupl-1\.[012]", r"european union public licen[cs]e", r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("artistic-2.0", r"artistic-(?:1\.0|2\.0)", r"artistic licen[cs]e(?:,? (?:version )?[12]\.0)?", r"perlfoundation\.org/artistic"),
    ("zlib", r"zlib", r"zlib(?:/libpng)? licen[cs]e", r"zlib\.net/zlib_licen[cs]e"),
    ("bsl-1.0", r"bsl-1\.0", r"boost software licen[cs]e", r"boost\.org/licen[cs]e_1_0"),
    ("busl-1.1", r"busl-1\.1", r"business source licen[cs]e", r"mariadb\.com/bsl11"),
    ("sspl-1.0", r"sspl-1\.0", r"server side public licen[cs]e", r"mongodb\.com/licensing/server-side-public-licen[cs]e"),
    ("elastic-2.0", r"elastic-2\.0", r"elastic licen[cs]e", r"elastic\.co/licensing/elastic-licen[cs]e"),
    ("unlicense", r"unlicense", r"released under the unlicense|the unlicense", r"unlicense\.org"),
    ("wtfpl", r"wtfpl", r"do what the f\w* you want to public licen[cs]e", r"wtfpl\.net"),
    ("cc0-1.0", r"cc0-1\.0", r"cc0(?: 1\.0)?(?: universal)?|creative commons zero", r"creativecommons\.org/publicdomain/zero"),
    ("cc-pdm", r"cc-pddc", r"public domain mark|dedicated to the public domain|released into the public domain", r"creativecommons\.org/publicdomain/mark"),
    ("cc-by", r"cc-by-[1-4]\.[05]", r"creative commons attribution(?: [1-4]\.[05])?(?: (?:international|generic|unported))?(?: licen[cs]e)?|cc[ -]by [1-4]\.[05]", r"creativecommons\.org/licen[cs]es/by/"),
    ("cc-by-sa", r"cc-by-sa-[1-4]\.[05]", r"creative commons attribution[- ]share-?alike|cc[ -]by-sa(?: [1-4]\.[05])?", r"creativecommons\.org/licen[cs]es/by-sa/"),
    ("cc-by-nc", r"cc-by-nc-[1-4]\.[05]", r"creative commons attribution[- ]non-?commercial|cc[ -]by-nc(?: [1-4]\.[05])?", r"creativecommons\.org/licen[cs]es/by-nc/"),
    ("cc-by-nd", r"cc-by-nd-[1-4]\.[05]", r"creative commons attribution[- ]no-?deriv\w+|cc[ -]by-nd(?: [1-4]\.[05])?", r"creativecommons\.org/licen[cs]es/by-nd/"),
    ("cc-by-nc-sa", r"cc-by-nc-sa-[1-4]\.[05]", r"creative commons attribution[- ]non-?commercial[- ]share-?alike|cc[ -]by-nc-sa(?: [1-4]\.[05])?", r"creativecommons\.org/licen[cs]es/by-nc-sa/"),
    ("cc-by-nc-nd", r"cc-by-nc-nd-[1-4]\.[05]", r"creative commons attribution[- ]non-?commercial[- ]no-?deriv\w+|cc[ -]by-nc-nd(?: [1-4]\.[05])?", r"creativecommons\.org/licen[cs]es/by-nc-nd/"),
    ("odbl-1.0", r"odbl-1\.0", r"open (?:data commons open )?database licen[cs]e", r"opendatacommons\.org/licen[cs]es/odbl"),
    ("odc-by-1.0", r"odc-by-1\.0", r"open data commons attribution licen[cs]e", r"opendatacommons\.org/licen[cs]es/by"),
    ("pddl-1.0", r"pddl-1\.0", r"public domain dedication and licen[cs]e", r"opendatacommons\.org/licen[cs]es/pddl"),
    ("ogl-uk", r"ogl-uk-[123]\.0", r"open government licen[cs]e", r"nationalarchives\.gov\.uk/doc/open-government-licen[cs]e"),
    ("ofl-1.1", r"ofl-1\.[01]", r"sil open font licen[cs]e|open font licen[cs]e", r"scripts\.sil\.org/ofl"),
    ("psf-2.0", r"(?:psf|python)-2\.0(?:\.1)?", r"python software foundation licen[cs]e|psf licen[cs]e", r"docs\.python\.org/\d/licen[cs]e"),
    ("php-3.0", r"php-3\.01?", r"php licen[cs]e", r"php\.net/licen[cs]e"),
    ("ruby", r"ruby", r"ruby licen[cs]e", r"ruby-lang\.org/\w+/licen[cs]e"),
    ("postgresql", r"postgresql", r"postgresql licen[cs]e", r"opensource\.org/licen[cs]es/postgresql"),
    ("openssl", r"openssl", r"openssl licen[cs]e", r"openssl\.org/source/licen[cs]e"),
    ("ncsa", r"ncsa", r"university of illinois/ncsa open source licen[cs]e", r"opensource\.org/licen[cs]es/ncsa"),
    ("afl-3.0", r"afl-[123]\.[012]", r"academic free licen[cs]e", r"opensource\.org/licen[cs]es/afl-3\.0"),
    ("osl-3.0", r"osl-[123]\.[01]", r"open software licen[cs]e", r"opensource\.org/licen[cs]es/osl-3\.0"),
    ("ms-pl", r"ms-pl", r"microsoft public licen[cs]e", r"opensource\.org/licen[cs]es/ms-pl"),
    ("ms-rl", r"ms-rl", r"microsoft reciprocal licen[cs]e", r"opensource\.org/licen[cs]es/ms-rl"),
    ("cecill", r"cecill-(?:[12]\.[01]|b|c)", r"cecill(?:-[bc])?(?: free software)? licen[cs]e", r"cecill\.info/licen[cs]es"),
    ("eiffel-2.0", r"efl-[12]\.0", r"eiffel forum licen[cs]e", r"opensource\.org/licen[cs]es/ver2_eiffel"),
    ("upl-1.0", r"upl-1\.0", r"universal permissive licen[cs]e", r"opensource\.org/licen[cs]es/upl"),
    ("mulan-2.0", r"mulanpsl-[12]\.0", r"mulan permissive software licen[cs]e", r"licen[cs]e\.coscl\.org\.cn/mulanpsl"),
    ("blueoak-1.0", r"blueoak-1\.0\.0", r"blue oak model licen[cs]e", r"blueoakcouncil\.org/licen[cs]e"),
    ("hippocratic", r"hippocratic-[12]\.[01]", r"hippocratic licen[cs]e", r"firstdonoharm\.dev"),
    ("openrail", r"(?:creativeml-|bigscience-)?openrail(?:-m|\+\+)?", r"(?:creativeml |bigscience )?open ?rail(?:-m|\+\+)?(?: licen[cs]e)?|responsible ai licen[cs]e", r"licenses\.ai"),
    ("lppl", r"lppl-1\.[0-3][ac]?", r"latex project public licen[cs]e", r"latex-project\.org/lppl"),
]
#: Rules that belong to no one license: label, priority, keyword, pattern, confidence.
#: A keyword is text that every match holds; of several one must be there.
GENERAL = [
    ("gpl", 30, "licen", r"(?:gnu )?general public licen[cs]e", 0.8),
    ("gpl", 20, "gpl", r"\bgpl\b", 0.5),
    ("bsd", 30, "bsd", r"\bbsd licen[cs]e", 0.7),
    ("cc", 30, "creative", r"creative commons(?: licen[cs]e)?", 0.6),
    ("public-domain", 30, "domain", r"in the public domain|public domain work", 0.6),
    ("apache", 30, "apache", r"apache licen[cs]e", 0.6),
    ("reserved", 30, "reserved", r"(?:all|some|no) rights reserved", 0.6),
    ("proprietary", 35, "proprietary", r"proprietary and confidential|proprietary (?:software|licen[cs]e)", 0.8),
    ("proprietary", 35, "permission", r"may not be (?:reproduced|distributed|copied|published)[^.]{0,80}without (?:the )?(?:prior )?(?:express )?(?:written )?permission", 0.8),
    ("copyright", 10, "copyright", r"copyright(?: ?\(c\)| ?©)? ?(?:19|20)\d\d", 0.4),
    ("copyright", 10, "©", r"© ?(?:19|20)\d\d", 0.4),
    ("mit", 60, "hereby", r"permission is hereby granted, free of charge, to any person obtaining a copy", 0.95),
    ("isc", 60, "permission", r"permission to use, copy, modify, and(?:/or)? distribute this software", 0.9),
    ("bsd", 60, "redistribution", r"redistribution and use in source and binary forms", 0.9),
    ("zlib", 60, "as-is", r"this software is provided 'as-is', without any express or implied warranty", 0.9),
    ("unlicense", 60, "unencumbered", r"this is free and unencumbered software released into the public domain", 0.95),
    ("gpl", 60, "redistribute", r"this (?:program|library|file) is free software[;:,] you can redistribute it", 0.9),
    ("apache-2.0", 60, "compliance", r"you may not use this file except in compliance with the licen[cs]e", 0.8),
    ("unknown-license", 5, "licen", r"licen[cs]ed under (?:the )?(?:terms of )?[^\n.]{3,60}", 0.3),
]


#: Keywords (one word, as a wrapped notice has them) of names that have no "licen" in them.
_BARE = {"bsd": "bsd", "gpl": "gpl", "cc0": "cc0", "cc[ -]by": "cc", "creative commons": "creative", "public domain": "domain", "unlicense": "unlicense", "rail": "rail"}
_GAP = r"(?:\s[\s*#/;%>!|-]*)"


def _keyword(name: str) -> str:
    return next((word for part, word in _BARE.items() if part in name), "licen")


def _wrapped(pattern: str) -> re.Pattern:
    """The regex with its spaces (outside of sets) taking wrapped and commented lines."""
    return re.compile(re.sub(r"\[[^\]]*\]| ", lambda m: _GAP if m[0] == " " else m[0], pattern))


@functools.cache
def rules() -> list[tuple[str, int, tuple[str, ...], re.Pattern, float]]:
    """All rules: tag, address and grant for each license, one for each of its names, and the general ones, the most specific with the highest priority."""
    out = []
    for label, tag, names, address in LICENSES:
        out.append((label, 90, ("spdx",), _wrapped(rf"spdx-license-identifier:\s*(?:{tag})(?![\w.-])"), 1.0))
        out.append((label, 80, ("://",), _wrapped(rf"https?://(?:www\.)?(?:{address})\S*"), 0.95))
        each = re.split(r"\|(?![^(]*\))", names)
        out.append((label, 70, tuple(sorted({_keyword(name) for name in each})), _wrapped(rf"(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:{names})(?![\w-])"), 0.95))
        for name in each:
            out.append((label, 50, (_keyword(name),), _wrapped(rf"(?<![\w-])(?:{name})(?![\w-])"), 0.85))
    return out + [(label, priority, (keyword,), _wrapped(pattern), confidence) for label, priority, keyword, pattern, confidence in GENERAL]


@functools.cache
def _gated() -> dict[tuple[str, ...], list[int]]:
    """Rules by keywords."""
    by: dict[tuple[str, ...], list[int]] = {}
    for i, rule in enumerate(rules()):
        by.setdefault(rule[2], []).append(i)
    return by


def detections(low: str) -> list[tuple[int, int, str, float]]:
    """Spans (start, end, label, confidence) in lower-cased text after suppression, in order of their start."""
    found: dict[int, list[tuple[int, int, str, float]]] = {}
    for words, numbers in _gated().items():
        if any(w in low for w in words):
            for i in numbers:
                label, priority, _, pattern, confidence = rules()[i]
                found.setdefault(-priority, []).extend((m.start(), -m.end(), label, confidence) for m in pattern.finditer(low))
    kept: list[tuple[int, int, str, float]] = []
    for level in sorted(found):
        # by start, longest first: a span lies in another if one before it ends no earlier
        reach, after = -1, []
        for old, span in sorted([(x[:2], (0, x)) for x in kept] + [(x[:2], (1, x)) for x in found[level]]):
            if not span[0] or -old[1] > reach:
                after.append(span[1])
            reach = max(reach, -old[1])
        kept = after
    return sorted((s, -e, label, confidence) for s, e, label, confidence in kept)


@functools.cache
def _phrases() -> list[tuple[str, re.Pattern, str]]:
    return [(p.split()[0], re.compile(rf"(?<!{_IN})" + rf"{_OUT}+".join(map(re.escape, p.split())) + rf"(?!{_IN})"), label) for p, label in PHRASES]


_WORDS_ONLY = bytes(i if i > 0x7F or chr(i).isalnum() else 0x20 for i in range(256))


def count_words(text: str) -> int:
    """Words of lower-cased text: runs of ASCII letters and digits and of bytes beyond ASCII."""
    return len(text.encode("utf-8", "surrogatepass").translate(_WORDS_ONLY).split())


def examine(text: str) -> dict:
    """Everything the scan says about one text."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only
    places, base = [], set()
    for first, pattern, label in _phrases():
        if first in low:
            for m in pattern.finditer(low):
                places.append(m.start())
                base.add(label)
    n_words = count_words(low)
    words = []
    if places:
        lo, hi = min(places), max(places)
        first_word = count_words(low[:lo])
        words = [first_word, first_word + count_words(low[lo:hi])]
    found = detections(low)
    labels = sorted(base | {x[2] for x in found})
    score = max([x[3] for x in found] + [0.9] * bool(base), default=0.0)
    spans = [{"start": s, "end": e, "label": x, "confidence": c} for s, e, x, c in found]
    return {"n_words": n_words, "n_base": len(places), "first_word": words[0] if words else None, "last_word": words[1] if words else None, "base_labels": ",".join(sorted(base)), "labels": ",".join(labels), "score": score, "detections": spans}


_KIND = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("confidence", pa.float64())])))])
_NAMES = [f.name for f in _KIND]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and detections (columns of these names are replaced).

    A null text is empty: zeros, null places and empty labels. ``detections`` are the spans
    that the rules keep, in code points; ``score`` is the highest confidence of a rule, 0.9
    at least with a base phrase.
    """

    @F.arrow_udf("struct<n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start int, end int, label string, confidence double>>>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([examine(t or "") for t in column.to_pylist()], _KIND)

    [x] = fresh(docs, "_l")
    return docs.withColumn(x, run(F.col(text))).drop(*_NAMES).select("*", f"{x}.*").drop(x)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", *_NAMES)
