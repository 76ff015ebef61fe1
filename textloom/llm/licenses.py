"""License scans by ordered signature rules, in DataFrame functions alone.

Rules are regular expressions over a text's words (ASCII letters lower-cased, one space between words), each with a
label, a priority and a confidence: four forms of each name, and sentences that only one licence's text has. The strings
of which every match of a rule holds one are read off its expression (keywords()); a text with none of any rule's is scanned no further, and a
rule is tried only where one of its own stands. Of overlapping detections, one that lies inside another of the same or a
higher priority is suppressed.

Time is linear in a text but for the sort of its detections. Defined results: a null or empty text has no words and no labels;
a text without detections scores 0; repeated rows give repeated results.
"""

from __future__ import annotations

import re
import string
from functools import cache
from re import _constants as sre
from re import _parser as sre_parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table, texts

#: What parts lower-cased words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label, identifier as words, name as words.
NAMES = (
    ("mit", "mit", r"(?:the )?mit licen[cs]e"),
    ("mit", "expat", r"(?:the )?expat licen[cs]e"),
    ("mit-0", "mit 0", r"mit (?:no attribution|0) licen[cs]e|mit no attribution"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("apache-1", "apache 1 [01]", r"apache (?:software )?licen[cs]e (?:version |v)?1(?: [01])?"),
    ("apache-2", "apache 2 0", r"apache (?:software )?licen[cs]e (?:version |v)?2(?: 0)?|apache 2(?: 0)? licen[cs]e"),
    ("bsd-0", "0bsd", r"(?:zero clause bsd|0bsd)(?: licen[cs]e)?"),
    ("bsd-1", "bsd 1 clause", r"(?:bsd 1 clause|1 clause bsd)(?: licen[cs]e)?"),
    ("bsd-2", "bsd 2 clause", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?"),
    ("bsd-3", "bsd 3 clause", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?"),
    ("bsd-4", "bsd 4 clause", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("libpng", "libpng", r"libpng licen[cs]e"),
    ("boost", "bsl 1 0", r"boost software licen[cs]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("gpl", "gpl", r"(?:gnu )?gpl(?: licen[cs]e)?"),
    ("gpl", "gpl", r"gnu general public licen[cs]e"),
    ("gpl-1", "gpl 1 0(?: only| or later)?", r"(?:gnu )?gpl ?v?(?:version )?1(?: 0)?"),
    ("gpl-2", "gpl 2 0(?: only| or later)?", r"(?:gnu )?gpl ?v?(?:version )?2(?: 0)?|gplv2"),
    ("gpl-2", "gnu gpl 2", r"gnu general public licen[cs]e (?:version |v)2(?: 0)?"),
    ("gpl-3", "gpl 3 0(?: only| or later)?", r"(?:gnu )?gpl ?v?(?:version )?3(?: 0)?|gplv3"),
    ("gpl-3", "gnu gpl 3", r"gnu general public licen[cs]e (?:version |v)3(?: 0)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: licen[cs]e)?"),
    ("lgpl", "gnu lgpl", r"gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", r"(?:gnu )?lgpl ?v?(?:version )?2(?: 1)?"),
    ("lgpl-2.1", "gnu lgpl 2 1", r"gnu lesser general public licen[cs]e (?:version |v)2(?: 1)?"),
    ("lgpl-3", "lgpl 3 0(?: only| or later)?", r"(?:gnu )?lgpl ?v?(?:version )?3(?: 0)?"),
    ("lgpl-3", "gnu lgpl 3", r"gnu lesser general public licen[cs]e (?:version |v)3(?: 0)?"),
    ("agpl-3", "agpl 3 0(?: only| or later)?", r"(?:gnu )?agpl(?: ?v?(?:version )?3(?: 0)?)?"),
    ("agpl-3", "gnu agpl 3", r"gnu affero general public licen[cs]e(?: (?:version |v)3)?"),
    ("fdl", "gfdl 1 [123]", r"gnu free documentation licen[cs]e"),
    ("mpl-1.1", "mpl 1 1", r"mozilla public licen[cs]e (?:version |v)?1 1"),
    ("mpl-2", "mpl 2 0", r"mozilla public licen[cs]e(?: (?:version |v)?2(?: 0)?)?"),
    ("epl-1", "epl 1 0", r"eclipse public licen[cs]e (?:version |v)?1 0"),
    ("epl-2", "epl 2 0", r"eclipse public licen[cs]e(?: (?:version |v)?2 0)?"),
    ("cddl", "cddl 1 [01]", r"common development and distribution licen[cs]e"),
    ("cpl", "cpl 1 0", r"common public licen[cs]e"),
    ("ibm-pl", "ipl 1 0", r"ibm public licen[cs]e"),
    ("artistic-1", "artistic 1 0", r"artistic licen[cs]e (?:version |v)?1(?: 0)?"),
    ("artistic-2", "artistic 2 0", r"artistic licen[cs]e(?: (?:version |v)?2(?: 0)?)?"),
    ("eupl", "eupl 1 [012]", r"european union public licen[cs]e"),
    ("ms-pl", "ms pl", r"microsoft public licen[cs]e"),
    ("ms-rl", "ms rl", r"microsoft reciprocal licen[cs]e"),
    ("osl-3", "osl 3 0", r"open software licen[cs]e"),
    ("afl-3", "afl 3 0", r"academic free licen[cs]e"),
    ("python", "psf 2 0|python 2 0", r"python (?:software foundation )?licen[cs]e"),
    ("php", "php 3 01?", r"php licen[cs]e"),
    ("ruby", "ruby", r"ruby licen[cs]e"),
    ("perl", "perl", r"same terms as perl(?: 5)? (?:itself|licen[cs]e)|perl licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("curl", "curl", r"curl licen[cs]e"),
    ("ofl", "ofl 1 [01]", r"(?:sil )?open font licen[cs]e"),
    ("nasa", "nasa 1 3", r"nasa open source (?:agreement|licen[cs]e)"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e"),
    ("vim", "vim", r"vim licen[cs]e"),
    ("upl", "upl 1 0", r"universal permissive licen[cs]e"),
    ("odbl", "odbl 1 0", r"open (?:data commons open )?database licen[cs]e"),
    ("odc-by", "odc by 1 0", r"open data commons attribution licen[cs]e"),
    ("pddl", "pddl 1 0", r"public domain dedication and licen[cs]e"),
    ("bsl", "busl 1 1", r"business source licen[cs]e"),
    ("sspl", "sspl 1 0", r"server side public licen[cs]e"),
    ("elastic-2", "elastic 2 0", r"elastic licen[cs]e(?: 2(?: 0)?)?"),
    ("cc0", "cc0 1 0", r"cc0(?: 1 0)?(?: universal)?(?: licen[cs]e)?"),
    ("cc-by", "cc by [1234] [05]", r"cc by(?: [1234] [05])?(?: (?:international|licen[cs]e))*"),
    ("cc-by-sa", "cc by sa [1234] [05]", r"cc by sa(?: [1234] [05])?(?: (?:international|licen[cs]e))*"),
    ("cc-by-nd", "cc by nd [1234] [05]", r"cc by nd(?: [1234] [05])?(?: (?:international|licen[cs]e))*"),
    ("cc-by-nc", "cc by nc [1234] [05]", r"cc by nc(?: [1234] [05])?(?: (?:international|licen[cs]e))*"),
    ("cc-by-nc-sa", "cc by nc sa [1234] [05]", r"cc by nc sa(?: [1234] [05])?(?: (?:international|licen[cs]e))*"),
    ("cc-by-nc-nd", "cc by nc nd [1234] [05]", r"cc by nc nd(?: [1234] [05])?(?: (?:international|licen[cs]e))*"),
    ("cc-by", "creative commons by", r"creative commons attribution(?: [1234] [05])?(?: (?:international|unported|licen[cs]e))*"),
    ("cc-by-sa", "creative commons by sa", r"creative commons attribution share ?alike(?: [1234] [05])?(?: (?:international|unported|licen[cs]e))*"),
    ("cc-by-nc", "creative commons by nc", r"creative commons attribution non ?commercial(?: [1234] [05])?(?: (?:international|unported|licen[cs]e))*"),
    ("cc-by-nd", "creative commons by nd", r"creative commons attribution no ?deriv(?:ative|s)*(?: [1234] [05])?(?: (?:international|unported|licen[cs]e))*"),
    ("cc-by-nc-sa", "creative commons by nc sa", r"creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: (?:international|unported|licen[cs]e))*"),
)
#: Rules that no name stands for: label, priority, confidence, words.
NOTICES = (
    ("public-domain", 2, 0.8, r"(?:released (?:in|into|to)|in|dedicated to) the public domain"),
    ("proprietary", 2, 0.7, r"(?:copyright (?:c )?(?:[0-9]{1,9} )?(?:[^ ]{1,40} ){0,6})?all rights reserved"),
    ("copyright", 1, 0.4, r"copyright (?:c )?[0-9]{4}"),
    ("copyleft", 1, 0.4, r"copyleft"),
    ("unnamed", 1, 0.3, r"licen[cs]ed under(?: the| an?)?"),
    ("unnamed", 1, 0.3, r"(?:terms|conditions) of (?:this|the) licen[cs]e"),
    ("unnamed", 1, 0.3, r"see (?:the )?licen[cs]e(?: file)? for"),
)
#: Sentences of licence texts, as words: label, words. What lies between two of them is any text of bounded length.
SENTENCES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy[^.]{0,200}without restriction[^.]{0,400}copyright notice and this permission notice shall be included"),
    ("mit-0", r"permission is hereby granted free of charge to any person obtaining a copy[^.]{0,200}without restriction[^.]{0,260}furnished to do so the software is provided"),
    ("json", r"permission is hereby granted free of charge to any person obtaining a copy[^.]{0,800}shall be used for good not evil"),
    ("x11", r"permission is hereby granted free of charge to any person obtaining a copy[^.]{0,2000}except as contained in this notice the name"),
    ("ncsa", r"permission is hereby granted free of charge to any person obtaining a copy[^.]{0,400}redistributions of source code must retain the above copyright notice[^.]{0,700}neither the names? of"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("isc", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("bsd-0", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", r"permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: is hereby granted)? without fee"),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted[^.]{0,700}shall not be used in advertising or otherwise to promote"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ntp", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("bsd-1", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer this software is provided"),
    ("bsd-2", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3", r"redistributions in binary form must reproduce the above copyright notice[^.]{0,400}(?:neither the names? of|the names? of the authors? may not be used|may not be used to endorse or promote)"),
    ("bsd-4", r"redistributions in binary form must reproduce the above copyright notice[^.]{0,300}all advertising materials mentioning features[^.]{0,600}(?:neither the names? of|may not be used to endorse or promote)"),
    ("bsd-3-clear", r"redistributions? (?:and use|in binary form)[^.]{0,1500}no express or implied licenses to any party s patent rights are granted"),
    ("apache-1", r"redistributions in binary form must reproduce the above copyright notice[^.]{0,700}the end user documentation included with the redistribution[^.]{0,900}products derived from this software may not be called apache"),
    ("openssl", r"all advertising materials mentioning features or use of this software must display the following acknowledgment this product includes software developed by the openssl project"),
    ("ssleay", r"this product includes cryptographic software written by eric young"),
    ("apache-2", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2", r"subject to the terms and conditions of this licen[cs]e each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e"),
    ("zlib", r"in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", r"the origin of this source code must not be misrepresented altered versions must be plainly marked"),
    ("boost", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", r"you just do what the fuck you want to|do what the fuck you want to public licen[cs]e"),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("fsful", r"unlimited permission to copy and or distribute it with or without modifications as long as this notice is preserved"),
    ("fsfap", r"copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved"),
    ("blessing", r"may you do good and not evil may you find forgiveness for yourself and forgive others"),
    ("gpl", r"either version [23] of the licen[cs]e or at your option any later version"),
    ("gpl-2", r"free software foundation either version 2 of the licen[cs]e or at your option any later version"),
    ("gpl-3", r"free software foundation either version 3 of the licen[cs]e or at your option any later version"),
    ("lgpl-2.1", r"gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the licen[cs]e"),
    ("lgpl-2", r"gnu library general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e(?: or at your option any later version)?"),
    ("lgpl-3", r"gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e(?: or at your option any later version)?"),
    ("agpl-3", r"gnu affero general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e(?: or at your option any later version)?"),
    ("gpl-2", r"the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public licen[cs]e is intended to guarantee"),
    ("gpl-3", r"the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works"),
    ("lgpl-2.1", r"this licen[cs]e the lesser general public licen[cs]e applies to some specially designated software packages"),
    ("lgpl-3", r"this version of the gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3"),
    ("agpl-3", r"the gnu affero general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works specifically designed to ensure cooperation"),
    ("fdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("gpl-exception", r"as a special exception[^.]{0,200}permission to link"),
    ("classpath", r"linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 [01]"),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-2", r"if a copy of the mpl was not distributed with this file you can obtain one"),
    ("npl", r"the contents of this file are subject to the netscape public licen[cs]e"),
    ("epl-1", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v1 0"),
    ("epl-2", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e(?: v)? ?2 0"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("cpl", r"the accompanying program is provided under the terms of this common public licen[cs]e"),
    ("artistic-1", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2", r"you are permitted to use the standard version and create and use modified versions for any purpose without restriction"),
    ("ofl", r"permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("ofl", r"the goals of the open font licen[cs]e ofl are to stimulate worldwide development of collaborative font projects"),
    ("ms-pl", r"this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e"),
    ("python", r"this licen[cs]e agreement is between the python software foundation psf and the individual or organization licensee"),
    ("php", r"this product includes php software freely available from"),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("vim", r"there are no restrictions on distributing unmodified copies of vim except that they must include this licen[cs]e text"),
    ("w3c", r"permission to copy modify and distribute this (?:software and its documentation|work) with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("zpl", r"servicemarks sm or trademarks tm of zope corporation"),
    ("unicode", r"obtaining a copy of the unicode data files and any associated documentation"),
    ("icu", r"provided that the above copyright notice s and this permission notice appear in all copies of the software"),
    ("upl", r"subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
    ("blueoak", r"everyone who contributes to this software gives you everything they are able to in order to make it free|blue oak model licen[cs]e"),
    ("mulan", r"mulan (?:psl|permissive software licen[cs]e)(?: v2)?"),
    ("eupl", r"this european union public licen[cs]e the eupl applies to the work"),
    ("sspl", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("bsl", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", r"the grant of rights under the licen[cs]e will not include and the licen[cs]e does not grant to you the right to sell the software"),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("cc", r"the work as defined below is provided under the terms of this creative commons public licen[cs]e"),
    ("cc", r"by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("odbl", r"the licensor grants to you a worldwide royalty free non exclusive terminable but only under section 9 licen[cs]e to use the database"),
    ("afl-3", r"licensed under the academic free licen[cs]e version 3 0"),
    ("osl-3", r"licensed under the open software licen[cs]e version 3 0"),
    ("rpl", r"reciprocal public licen[cs]e"),
    ("qpl", r"q public licen[cs]e version 1 0|the q public licen[cs]e"),
    ("cecill", r"cecill(?: [abc])?(?: licen[cs]e| free software licen[cs]e)"),
    ("nposl", r"non profit open software licen[cs]e"),
    ("watcom", r"sybase open watcom public licen[cs]e"),
    ("apsl", r"apple public source licen[cs]e"),
    ("intel", r"export laws this licen[cs]e adds no restrictions to the export laws of your jurisdiction"),
    ("proprietary", r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("non-commercial", r"for non ?commercial (?:use|purposes|research) only|free for (?:personal|academic|non ?commercial) use"),
    ("evaluation", r"for evaluation (?:use|purposes) only"),
)


class Rule(NamedTuple):
    order: int
    label: str
    priority: int
    confidence: float
    pattern: str


@cache
def rules() -> tuple[Rule, ...]:
    """Four forms of each name, the notices, the sentences. Patterns take the space before and stop at one."""
    out = []
    for label, identifier, name in NAMES:
        out += [
            (label, 4, 1.0, f"spdx licen[cs]e identifier (?:{identifier})"),
            (label, 3, 0.95, f"(?:licen[cs]ed|released|distributed|available|published|covered|provided) (?:to you )?(?:under|by) (?:the )?(?:terms of )?(?:the |an? )?(?:{name})"),
            (label, 3, 0.9, f"(?:licen[cs]e|licence type|licen[cs]e terms) (?:is )?(?:the )?(?:{name})"),
            (label, 2, 0.7, f"(?:{name})"),
        ]
    out += NOTICES
    out += [(label, 3, 0.95, words) for label, words in SENTENCES]
    return tuple(Rule(i, label, p, c, f" (?:{words})(?= )") for i, (label, p, c, words) in enumerate(out))


def keywords(pattern: str) -> frozenset[str]:
    """Strings of which every match of an expression holds one, as long as can be told: the best literal of a sequence, all branches of a choice."""

    def read(items) -> tuple[list[frozenset[str]], str | None]:
        """Sets that each hold for a match, and the one string that it is, if it is one."""
        sets: list[frozenset[str]] = []
        run, whole = "", True

        def close() -> None:
            nonlocal run
            if run:
                sets.append(frozenset([run]))
            run = ""

        for op, value in items:
            if op is sre.LITERAL:
                run += chr(value)
                continue
            if op is sre.SUBPATTERN:
                inner, text = read(value[3])
                if text is not None:
                    run += text
                    continue
            elif op is sre.BRANCH:
                parts = [read(x) for x in value[1]]
                inner = [frozenset().union(*map(_best, (p for p, _ in parts)))] if all(p for p, _ in parts) else []
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] > 0:
                inner, _ = read(value[2])
            elif op in (sre.ASSERT, sre.AT):
                continue
            else:
                inner = []
            whole = False
            close()
            sets += inner
        text = run if whole and not sets else None
        close()
        return sets, text

    return _best(read(sre_parser.parse(pattern))[0])


def _best(sets: list[frozenset[str]]) -> frozenset[str]:
    letters = lambda s: min(len(k.replace(" ", "")) for k in s)
    return max(sets, key=lambda s: (letters(s), -len(s)), default=frozenset())


def gate(given: tuple[Rule, ...]) -> str:
    """An expression found in every text that has a keyword of any rule; alternatives share their beginnings."""
    words = frozenset().union(*(keywords(r.pattern) for r in given))
    tree: dict = {}
    for w in sorted(w for w in words if not any(k in w for k in words if k != w)):
        at = tree
        for c in w:
            at = at.setdefault(c, {})

    def told(at: dict) -> str:
        parts = [re.escape(c) + told(below) for c, below in at.items()]
        return "" if not parts else parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return told(tree)


PRIORITIES = 4


def _count(text: Column, what: str | Column, size: int) -> Column:
    what = F.lit(what) if isinstance(what, str) else what
    return ((F.char_length(text) - F.char_length(F.replace(text, what, F.lit("")))) / size).cast("long")


def _placed(parts: Column, found: Column, at: Column) -> Column:
    """struct<at, got>: end of the last match, and (start, end) of each, from what stands before each match and the matches."""
    empty = F.expr("cast(array() as array<struct<start:int,back:int>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["part"])
        end = start + F.char_length(x["found"])
        return F.struct(end.alias("at"), F.array_append(acc["got"], F.struct(start.alias("start"), (-end).alias("back"))).alias("got"))

    pairs = F.arrays_zip(parts.alias("part"), found.alias("found"))
    return F.aggregate(pairs, F.struct(at.alias("at"), empty.alias("got")), step)


#: Matches that are placed in one go: an array grows by copying, so that it is kept short.
PORTION = 128


def detections(words: Column, given: tuple[Rule, ...]) -> Column:
    """array<struct<start, back, rank, order, label, confidence>> sorted: containers come before what they contain."""
    lit = lambda r: F.struct(*[F.lit(x).alias(k) for k, x in r._asdict().items()], F.array(*map(F.lit, sorted(keywords(r.pattern)))).alias("keys"))
    table = F.array(*map(lit, given))

    def spans(r: Column) -> Column:
        found = F.struct(F.split(words, r["pattern"], -1).alias("parts"), F.regexp_extract_all(words, r["pattern"], F.lit(0)).alias("found"))

        def portioned(x: Column) -> Column:
            cut = lambda a, i: F.slice(a, i * PORTION + 1, PORTION)
            numbers = F.sequence(F.lit(0), F.floor((F.size(x["found"]) - 1) / PORTION).cast("int"))
            length = lambda a: F.aggregate(a, F.lit(0), lambda acc, t: acc + F.char_length(t))
            # where each portion starts, then places within it
            sizes = F.transform(numbers, lambda i: length(cut(F.slice(x["parts"], 1, F.size(x["found"])), i)) + length(cut(x["found"], i)))
            starts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
            ends = F.transform(F.arrays_zip(numbers.alias("i"), F.slice(starts, 1, F.size(numbers)).alias("at")), lambda p: _placed(cut(F.slice(x["parts"], 1, F.size(x["found"])), p["i"]), cut(x["found"], p["i"]), p["at"])["got"])
            return F.flatten(ends)

        places = F.flatten(F.transform(F.filter(F.array(found), lambda x: F.size(x["found"]) > 0), portioned))
        return F.transform(places, lambda x: F.struct(x["start"], x["back"], (-r["priority"]).alias("rank"), r["order"].alias("order"), r["label"].alias("label"), r["confidence"].alias("confidence")))

    tried = F.filter(table, lambda r: F.exists(r["keys"], lambda k: F.contains(words, k)))
    return F.array_sort(F.flatten(F.transform(tried, spans)))


def resolved(found: Column) -> Column:
    """Labels and the highest confidence of detections that none of the same or a higher priority contains."""
    ends = [f"e{p}" for p in range(1, PRIORITIES + 1)]
    zero = F.struct(*[F.lit(0).alias(e) for e in ends], F.expr("cast(array() as array<string>)").alias("labels"), F.lit(0.0).alias("score"))

    def step(acc: Column, d: Column) -> Column:
        inside = F.lit(False)
        for p, e in enumerate(ends, 1):
            inside = inside | ((-d["rank"] <= p) & (acc[e] >= -d["back"]))
        grown = [F.when(~inside & (-d["rank"] == p), F.greatest(acc[e], -d["back"])).otherwise(acc[e]).alias(e) for p, e in enumerate(ends, 1)]
        labels = F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"])))
        score = F.when(inside, acc["score"]).otherwise(F.greatest(acc["score"], d["confidence"]))
        return F.struct(*grown, labels.alias("labels"), score.alias("score"))

    return F.aggregate(found, zero, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["score"].alias("score")))


def _words(text: Column | str) -> Column:
    """A text's words, A-Z lower-cased, with a space before, between and behind."""
    text = F.col(text) if isinstance(text, str) else text
    # lower() changes nothing but A-Z in ASCII, where it is much cheaper
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, GAP, " ")), F.lit(" "))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one scan, no shuffle."""
    given = rules()
    docs = texts(docs).select("doc_id", _words("text").alias("words"))
    n_words = F.when(F.col("words") == "  ", 0).otherwise(F.octet_length("words") - F.octet_length(F.replace("words", F.lit(" "), F.lit(""))) - 1).cast("long")
    has_base = F.lit(False)
    for phrase, _ in BASE:
        has_base = has_base | F.contains("words", F.lit(f" {phrase} "))
    # two spaces between words there, so that each word has its own two
    spaced = F.when(has_base, F.replace("words", F.lit(" "), F.lit("  ")))
    docs = docs.select("doc_id", "words", n_words.alias("n_words"), spaced.alias("spaced"))
    docs = docs.withColumn("found", F.when(F.col("words").rlike(gate(given)), resolved(detections(F.col("words"), given))))
    before = lambda prefix: _count(prefix, " ", 2)
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE:
        p = " " + phrase.replace(" ", "  ") + " "
        there = F.coalesce(F.contains("spaced", F.lit(p)), F.lit(False))
        start = F.locate(p, F.col("spaced"))
        back = F.locate(p[::-1], F.reverse("spaced"))
        counts.append(F.when(there, _count(F.col("spaced"), p, len(p))).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(there, before(F.substring("spaced", F.lit(1), start - 1))))
        lasts.append(F.when(there, before(F.substring("spaced", F.lit(1), F.char_length("spaced") - back + 1 - len(p)))))
        labels.append(F.when(there, F.lit(label)))
    base = F.array_compact(F.array(*labels))
    none = F.expr("cast(array() as array<string>)")
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return docs.select(
        "doc_id",
        "n_words",
        sum(counts[1:], counts[0]).alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.coalesce("found.labels", none))).alias("labels"),
        F.coalesce("found.score", F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
