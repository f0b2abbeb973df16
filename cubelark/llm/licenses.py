"""License scans: ordered signature rules behind a keyword prefilter.

Rules are regular expressions over the text's words, lower-cased and joined by
one blank. One Aho-Corasick pass over a document's joined words tells which
keywords occur; only rules whose keyword occurs are run. A detection whose word
interval lies within that of a detection of an earlier kind (or a longer one of
its own kind) is suppressed; what is left gives the labels.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

#: Label | SPDX words | name as a pattern over words | keywords, one of which is in each branch of the name.
FAMILIES = """
apache-1.1 | apache 1 1 | apache (?:software )?license (?:version )?(?:v)?1 1 | apache
apache-2.0 | apache 2 0 | apache (?:software )?license (?:version )?(?:v ?)?2(?: 0)? | apache
mit | mit | mit(?: style| x11)? license | mit
bsd-2-clause | bsd 2 clause | (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd) license | bsd,freebsd
bsd-3-clause | bsd 3 clause | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd) license | bsd
bsd-4-clause | bsd 4 clause | (?:original bsd|bsd 4 clause|4 clause bsd) license | bsd
bsd | bsd | bsd(?: style)? license | bsd
0bsd | 0bsd | (?:zero clause bsd|bsd zero clause|0bsd) license | bsd,0bsd
isc | isc | isc license | isc
gpl-1.0 | gpl 1 0(?: only| or later)? | gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version )?(?:v ?)?1(?: 0)? | general public
gpl-2.0 | gpl 2 0(?: only| or later)? | gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version )?(?:v ?)?2(?: 0)? | general public
gpl-3.0 | gpl 3 0(?: only| or later)? | gnu general public license (?:as published by the free software foundation )?(?:either )?(?:version )?(?:v ?)?3(?: 0)? | general public
gpl | gpl | (?:gnu )?general public license | general public
lgpl-2.0 | lgpl 2 0(?: only| or later)? | gnu library general public license (?:version )?(?:v ?)?2(?: 0)? | general public
lgpl-2.1 | lgpl 2 1(?: only| or later)? | gnu lesser general public license (?:version )?(?:v ?)?2 1 | lesser
lgpl-3.0 | lgpl 3 0(?: only| or later)? | gnu lesser general public license (?:version )?(?:v ?)?3(?: 0)? | lesser
lgpl | lgpl | (?:gnu )?(?:lesser|library) general public license | general public
agpl-1.0 | agpl 1 0 | affero general public license (?:version )?(?:v ?)?1(?: 0)? | affero
agpl-3.0 | agpl 3 0(?: only| or later)? | (?:gnu )?affero general public license (?:version )?(?:v ?)?3(?: 0)? | affero
agpl | agpl | (?:gnu )?affero general public license | affero
gfdl-1.2 | gfdl 1 2 | gnu free documentation license (?:version )?1 2 | free documentation
gfdl-1.3 | gfdl 1 3 | gnu free documentation license (?:version )?1 3 | free documentation
gfdl | gfdl | (?:gnu )?free documentation license | free documentation
mpl-1.0 | mpl 1 0 | mozilla public license (?:version )?(?:v ?)?1 0 | mozilla
mpl-1.1 | mpl 1 1 | mozilla public license (?:version )?(?:v ?)?1 1 | mozilla
mpl-2.0 | mpl 2 0 | mozilla public license (?:version )?(?:v ?)?2(?: 0)? | mozilla
epl-1.0 | epl 1 0 | eclipse public license (?:version )?(?:v ?)?1(?: 0)? | eclipse
epl-2.0 | epl 2 0 | eclipse public license (?:version )?(?:v ?)?2(?: 0)? | eclipse
edl-1.0 | edl 1 0 | eclipse distribution license (?:version )?(?:v ?)?1(?: 0)? | eclipse
cddl-1.0 | cddl 1 0 | common development and distribution license (?:version )?1 0 | common development
cddl-1.1 | cddl 1 1 | common development and distribution license (?:version )?1 1 | common development
cddl | cddl | common development and distribution license | common development
cpl-1.0 | cpl 1 0 | common public license (?:version )?1 0 | common public
cpal-1.0 | cpal 1 0 | common public attribution license (?:version )?1 0 | attribution license
eupl-1.1 | eupl 1 1 | european union public licen[cs]e (?:version )?(?:v ?)?1 1 | european union
eupl-1.2 | eupl 1 2 | european union public licen[cs]e (?:version )?(?:v ?)?1 2 | european union
artistic-1.0 | artistic 1 0 | artistic license (?:version )?1 0 | artistic
artistic-2.0 | artistic 2 0 | artistic license (?:version )?2 0 | artistic
artistic | artistic | (?:perl )?artistic license | artistic
bsl-1.0 | bsl 1 0 | boost software license (?:version )?1 0 | boost
bsl | bsl | boost software license | boost
busl-1.1 | busl 1 1 | business source license (?:version )?1 1 | business source
cc0-1.0 | cc0 1 0 | (?:creative commons zero|cc0)(?: license)?(?: version)?(?: 1 0)?(?: universal)? | cc0,creative commons
cc-by-3.0 | cc by 3 0 | creative commons attribution (?:license )?(?:version )?3 0 | creative commons
cc-by-4.0 | cc by 4 0 | creative commons attribution (?:license )?(?:version )?4 0 | creative commons
cc-by-sa-3.0 | cc by sa 3 0 | creative commons attribution share ?alike (?:license )?(?:version )?3 0 | creative commons
cc-by-sa-4.0 | cc by sa 4 0 | creative commons attribution share ?alike (?:license )?(?:version )?4 0 | creative commons
cc-by-nc-4.0 | cc by nc 4 0 | creative commons attribution non ?commercial (?:license )?(?:version )?4 0 | creative commons
cc-by-nd-4.0 | cc by nd 4 0 | creative commons attribution no ?deriv(?:ative)?s (?:license )?(?:version )?4 0 | creative commons
cc-by-nc-sa-4.0 | cc by nc sa 4 0 | creative commons attribution non ?commercial share ?alike (?:license )?(?:version )?4 0 | creative commons
cc | cc | creative commons(?: attribution)? license | creative commons
odbl-1.0 | odbl 1 0 | open database license | open database
ofl-1.1 | ofl 1 1 | sil open font license(?: version 1 1)? | open font
psf-2.0 | psf 2 0 | python software foundation license(?: version 2)? | python
php-3.01 | php 3 01 | php license (?:version )?3 01 | php
ruby | ruby | ruby license | ruby
postgresql | postgresql | postgresql license | postgresql
openssl | openssl | openssl license | openssl
zlib | zlib | (?:zlib|zlib libpng) license | zlib
libpng-2.0 | libpng 2 0 | (?:png reference library|libpng) license | libpng,png reference
ncsa | ncsa | (?:university of illinois )?ncsa (?:open source )?license | ncsa
ms-pl | ms pl | microsoft public license | microsoft
ms-rl | ms rl | microsoft reciprocal license | microsoft
unlicense | unlicense | (?:the )?unlicense(?: license)? | unlicense
wtfpl | wtfpl | do what the f\\w* you want to public license | want to public
upl-1.0 | upl 1 0 | universal permissive license | universal permissive
osl-3.0 | osl 3 0 | open software license (?:version )?3 0 | open software
afl-3.0 | afl 3 0 | academic free license (?:version )?3 0 | academic free
qpl-1.0 | qpl 1 0 | q public license | q public
x11 | x11 | x11 license | x11
vim | vim | vim license | vim
w3c | w3c | w3c software (?:notice and )?license | w3c
lppl-1.3c | lppl 1 3c | latex project public license | latex
sspl-1.0 | sspl 1 0 | server side public license | server side
elastic-2.0 | elastic 2 0 | elastic license (?:version )?2(?: 0)? | elastic
proprietary | licenseref proprietary | proprietary license | proprietary
"""

#: Label | sentence as a pattern over words | keyword.
SENTENCES = """
mit | permission is hereby granted free of charge to any person obtaining a copy | hereby granted
isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | hereby granted
bsd | redistribution and use in source and binary forms with or without modification are permitted | redistribution
bsd-3-clause | neither the name of .{1,80}? nor the names of its contributors may be used | neither the name
bsd-4-clause | all advertising materials mentioning features or use of this software must display | advertising materials
apache-2.0 | you may not use this file except in compliance with the license | in compliance with
gpl | this program is free software you can redistribute it and or modify | free software
lgpl | this library is free software you can redistribute it and or modify | free software
mpl-2.0 | this source code form is subject to the terms of the mozilla public | source code form
unlicense | this is free and unencumbered software released into the public domain | unencumbered
zlib | this software is provided as is without any express or implied warranty in no event will the authors | express or implied
public-domain | (?:released|placed|dedicated) (?:in|into|to) the public domain | public domain
proprietary | all rights reserved | all rights
proprietary | (?:confidential|trade secret)s? (?:and|or) proprietary | proprietary
"""

#: Label | notice, title, address or clause as a pattern over words | keyword.
NOTICES = """
mit | (?:the )?above copyright notice and this permission notice shall be included in all copies | permission notice
mit | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability | merchantability
mit | in no event shall the authors or copyright holders be liable for any claim damages or other liability | copyright holders
mit | subject to the following conditions the above copyright notice and this permission notice | permission notice
mit-0 | mit no attribution | no attribution
mit | expat license | expat
mit-cmu | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted | documentation
x11 | except as contained in this notice the name of .{1,60}? shall not be used in advertising | except as contained
isc | the software is provided as is and the author disclaims all warranties with regard to this software | disclaims
0bsd | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software | hereby granted
bsd | redistributions of source code must retain the above copyright notice | redistributions
bsd | redistributions in binary form must reproduce the above copyright notice | redistributions
bsd-3-clause | may be used to endorse or promote products derived from this software without specific prior written permission | endorse
bsd-3-clause-clear | no express or implied licenses to any party s patent rights are granted by this license | patent rights
bsd-4-clause | this product includes software developed by the university of california | university of california
bsd-2-clause-patent | subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights | receiving rights
bsd-1-clause | bsd 1 clause license | bsd
bsd | berkeley software distribution | berkeley
apache-2.0 | apache org licenses license 2 0 | apache
apache-2.0 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis | applicable law
apache-2.0 | licensed to the apache software foundation asf under one or more contributor license agreements | apache
apache-2.0 | see the license for the specific language governing permissions and limitations under the license | governing permissions
apache-2.0 | grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you | patent license
apache-2.0 | apl(?: )?2(?: 0)? license | license
apache-1.1 | this product includes software developed by the apache software foundation | apache
gpl | gnu org copyleft gpl | copyleft
gpl | gnu org licenses gpl | gpl
gpl | this program is distributed in the hope that it will be useful but without any warranty | in the hope
gpl | you should have received a copy of the gnu general public license along with this program | should have received
gpl | free software foundation inc 51 franklin (?:st|street) | franklin
gpl | free software foundation inc 59 temple place | temple
gpl-2.0 | under the terms of the gnu general public license version 2 | general public
gpl-2.0 | version 2 june 1991 | june
gpl-3.0 | version 3 29 june 2007 | june
gpl-3.0 | gnu org licenses gpl 3 0 | gpl
gpl-2.0 | gnu org licenses old licenses gpl 2 0 | gpl
gpl-2.0 | gplv2 | gplv2
gpl-3.0 | gplv3 | gplv3
gpl-2.0-or-later | either version 2 of the license or at your option any later version | at your option
gpl-3.0-or-later | either version 3 of the license or at your option any later version | at your option
gpl-2.0 | covered by the gpl v ?2 | gpl
gpl-with-classpath-exception | linking this library statically or dynamically with other modules is making a combined work | combined work
gpl-with-autoconf-exception | as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script | configuration script
gpl-with-font-exception | as a special exception if you create a document which uses this font | special exception
gpl-with-bison-exception | as a special exception you may create a larger work that contains part or all of the bison parser skeleton | bison
gpl-with-gcc-exception | gcc runtime library exception | runtime library exception
lgpl | gnu org licenses lgpl | lgpl
lgpl | gnu org copyleft lesser | copyleft
lgpl | you should have received a copy of the gnu (?:lesser|library) general public license | should have received
lgpl-2.0 | either version 2 of the license or at your option any later version this library | at your option
lgpl-2.1 | either version 2 1 of the license or at your option any later version | at your option
lgpl-2.1 | lgplv2 1 | lgplv2
lgpl-3.0 | lgplv3 | lgplv3
lgpl-2.1 | version 2 1 february 1999 | february
agpl | gnu org licenses agpl | agpl
agpl-3.0 | agplv3 | agplv3
agpl-3.0 | gnu affero general public license version 3 19 november 2007 | affero
agpl-3.0 | if your software can interact with users remotely through a computer network | interact with users
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license | free documentation
gfdl | with no invariant sections no front cover texts and no back cover texts | invariant sections
mpl-2.0 | mozilla org mpl 2 0 | mozilla
mpl-1.1 | mozilla org mpl mpl 1 1 | mozilla
mpl-1.1 | the contents of this file are subject to the mozilla public license version 1 1 | mozilla
mpl | if a copy of the mpl was not distributed with this file you can obtain one at | mpl
npl-1.1 | netscape public license | netscape
epl | eclipse org legal epl | eclipse
epl-1.0 | eclipse org legal epl v10 | eclipse
epl-2.0 | eclipse org legal epl 2 0 | eclipse
epl | this program and the accompanying materials are made available under the terms of the eclipse | accompanying materials
edl-1.0 | eclipse org org documents edl v10 | eclipse
cddl | the contents of this file are subject to the terms of the common development and distribution license | common development
cddl | opensolaris org os licensing | opensolaris
cddl-1.0 | cddl version 1 0 | cddl
cpl-1.0 | ibm com developerworks library os cpl | developerworks
ipl-1.0 | ibm public license | ibm
eupl | european union public licen[cs]e | european union
eupl | joinup ec europa eu software page eupl | eupl
cecill-2.1 | cecill (?:free software )?licen[cs]e(?: agreement)?(?: version)? 2 1 | cecill
cecill | governed by the cecill(?: b| c)? licen[cs]e | cecill
cecill-b | cecill b free software license agreement | cecill
cecill-c | cecill c free software license agreement | cecill
artistic-1.0 | the intent of this document is to state the conditions under which a package may be copied | intent of this document
artistic | under the same terms as perl itself | perl itself
bsl-1.0 | boost org license 1 0 | boost
bsl-1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation | accompanying documentation
busl-1.1 | change date .{1,40}? change license | change license
cc0-1.0 | creativecommons org publicdomain zero 1 0 | publicdomain
cc0-1.0 | to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights | neighboring rights
cc-pddc | creativecommons org licenses publicdomain | publicdomain
cc-by | creativecommons org licenses by [1-4] | creativecommons
cc-by-sa | creativecommons org licenses by sa [1-4] | creativecommons
cc-by-nc | creativecommons org licenses by nc [1-4] | creativecommons
cc-by-nd | creativecommons org licenses by nd [1-4] | creativecommons
cc-by-nc-sa | creativecommons org licenses by nc sa [1-4] | creativecommons
cc-by-nc-nd | creativecommons org licenses by nc nd [1-4] | creativecommons
cc-by | this work is licensed under a creative commons attribution [1-4] | creative commons
cc-by-sa | text is available under the creative commons attribution share ?alike | creative commons
cc-by-sa | content is available under cc by sa | cc
cc-by | some rights reserved | some rights
odbl-1.0 | opendatacommons org licenses odbl | opendatacommons
odc-by-1.0 | opendatacommons org licenses by | opendatacommons
odc-by-1.0 | open data commons attribution license | open data
pddl-1.0 | open data commons public domain dedication | open data
odbl-1.0 | openstreetmap contributors | openstreetmap
ofl-1.1 | scripts sil org ofl | ofl
ofl-1.1 | this font software is licensed under the sil open font license | font software
ofl-1.1 | the fonts and derivatives however cannot be released under any other type of license | derivatives
lgpl-font | magenta open license | magenta
bitstream-vera | bitstream vera fonts copyright | bitstream
ubuntu-font-1.0 | ubuntu font licen[cs]e | ubuntu
psf-2.0 | psf license agreement for python | psf
cnri-python | cnri license agreement | cnri
php-3.01 | php net license | php
ruby | under the same terms as ruby(?: itself)? | ruby
postgresql | in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages | university of california
openssl | this product includes software developed by the openssl project | openssl
openssl | redistributions of any form whatsoever must retain the following acknowledgment | acknowledgment
ssleay | this product includes cryptographic software written by eric young | cryptographic
zlib | altered source versions must be plainly marked as such | plainly marked
zlib | this notice may not be removed or altered from any source distribution | source distribution
zlib | the origin of this software must not be misrepresented | misrepresented
libpng-2.0 | png reference library version | png reference
libtiff | the names of sam leffler and silicon graphics may not be used in any advertising | silicon graphics
ijg | this software is based in part on the work of the independent jpeg group | independent jpeg
ftl | portions of this software are copyright .{1,60}? the freetype project | freetype
ncsa | university of illinois open source license | illinois
curl | curl license | curl
icu | unicode license agreement | unicode
icu | icu license | icu
unicode-dfs-2016 | unicode inc license agreement data files and software | unicode
ms-pl | ms pl license | ms
ms-pl | if you use the software you accept this license if you do not accept the license do not use the software | accept the license
ms-eula | end user license agreement for microsoft | microsoft
unlicense | unlicense org | unlicense
unlicense | anyone is free to copy modify publish use compile sell or distribute this software | anyone is free
wtfpl | wtfpl | wtfpl
wtfpl | you just do what the f\\w* you want to | want to
beerware | the beer ware license | ware license
beerware | if we meet some day and you think this stuff is worth it you can buy me a beer | buy me
json | the software shall be used for good not evil | good not
jsr | specification lead hereby grants you | specification lead
upl-1.0 | universal permissive license upl | upl
osl-3.0 | licensed under the open software license version 3 0 | open software
afl-2.1 | academic free license (?:version )?2 1 | academic free
ecl-2.0 | educational community license | educational community
rpl-1.5 | reciprocal public license | reciprocal public
apsl-2.0 | apple public source license | apple public
watcom-1.0 | sybase open watcom public license | watcom
qpl-1.0 | the q public license version 1 0 | q public
sleepycat | sleepycat license | sleepycat
sissl | sun industry standards source license | sun industry
spl-1.0 | sun public license | sun public
zpl-2.1 | zope public license | zope
vsl-1.0 | vovida software license | vovida
xnet | x net license | x net
w3c | w3 org consortium legal copyright software | consortium
lppl-1.3c | this work may be distributed and or modified under the conditions of the latex project public license | latex
lppl-1.3c | latex project org lppl | lppl
sspl-1.0 | sspl v ?1 | sspl
elastic-2.0 | you may not provide the software to third parties as a hosted or managed service | managed service
commons-clause | commons clause license condition | commons clause
polyform-nc | polyform noncommercial license | polyform
polyform-sb | polyform small business license | polyform
prosperity-3.0 | prosperity public license | prosperity
hippocratic-2.1 | hippocratic license | hippocratic
openrail | open ?rail(?: m)? license | rail|openrail
openrail | bigscience rail license | bigscience
llama-community | llama 2 community license | llama
llama-community | llama 3 community license | llama
mulan-psl-2.0 | mulan permissive software license | mulan
artistic-2.0 | artistic license 2 0 | artistic
blueoak-1.0.0 | blue oak model license | blue oak
cern-ohl | cern open hardware licen[cs]e | open hardware
tapr-ohl | tapr open hardware license | open hardware
solderpad | solderpad hardware license | solderpad
etalab-2.0 | licence ouverte open licence | ouverte
ogl-uk-3.0 | open government licence | open government
dl-de-by-2.0 | datenlizenz deutschland namensnennung | datenlizenz
public-domain | this file is in the public domain | public domain
public-domain | no copyright is claimed and | no copyright
public-domain | works? of the united states government | states government
proprietary | this software is the confidential and proprietary information of | confidential
proprietary | unauthorized copying of this file via any medium is strictly prohibited | unauthorized copying
proprietary | no part of this (?:publication|document|work) may be reproduced | may be reproduced
proprietary | do not distribute without (?:prior )?written (?:permission|consent) | do not distribute
proprietary | for internal use only | internal use
freeware | this software is freeware | freeware
shareware | this software is shareware | shareware
commercial | commercial license agreement | commercial
"""

#: The shapes in which a family is named, the strongest first; {s}: SPDX words, {n}: name.
SHAPES = (
    ("tag", 1.0, r"spdx license identifier {s}", "spdx"),
    ("grant", 0.95, r"(?:licensed|released|distributed|available|published|covered|provided) under (?:an? )?(?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{n}|{s})", "licensed|released|distributed|available|published|covered|provided"),
    ("terms", 0.9, r"(?:subject to|governed by|under) the (?:terms (?:and conditions )?of the )?{n}", None),
    ("link", 0.85, r"(?:opensource org|spdx org|choosealicense com|gnu org|creativecommons org) licenses? {s}", "opensource org|spdx org|choosealicense com|gnu org|creativecommons org"),
    ("name", 0.7, r"{n}", None),
)
SENTENCE = 0.8
#: The phrases that always count, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@cache
def rules() -> list[tuple[int, float, str, str, re.Pattern]]:
    """(kind, weight, label, keywords, pattern), in order of priority."""
    rows = lambda table: [[x.strip() for x in line.split(" | ")] for line in table.strip().splitlines()]
    out = []
    for kind, (_, weight, shape, gate) in enumerate(SHAPES):
        for label, spdx, name, keyword in rows(FAMILIES):
            pattern = shape.format(s=spdx, n=f"(?:{name})")
            out.append((kind, weight, label, gate or keyword.replace(",", "|"), re.compile(f"(?<= )(?:{pattern})(?= )".encode())))
    for label, pattern, keyword in rows(SENTENCES) + rows(NOTICES):
        out.append((1, SENTENCE, label, keyword, re.compile(f"(?<= )(?:{pattern})(?= )".encode())))
    return sorted(out, key=lambda r: r[0])


def suppress(found: list[tuple[int, int, int, float, str]]) -> list[tuple[int, int, int, float, str]]:
    """Drop (start, end, kind, weight, label) that lie within a kept one of an earlier kind or a longer one of their kind.

    The outermost kept spans ascend in start and end alike, so the last one that
    starts no later than a span is the only one that has to be looked at.
    """
    kept, starts, ends = [], [], []
    for one in sorted(found, key=lambda x: (x[2], x[0] - x[1], x[0], x[4])):
        at = bisect_right(starts, one[0])
        if at and ends[at - 1] >= one[1]:
            continue
        kept.append(one)
        first, last = bisect_left(starts, one[0]), bisect_right(ends, one[1])
        starts[first : max(first, last)], ends[first : max(first, last)] = [one[0]], [one[1]]
    return sorted(kept)


class Scanner:
    """Detections and base places in a document's words."""

    def __init__(self):
        self.rules = rules()
        self.gates = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            for keyword in r[3].split("|"):
                by.setdefault(keyword, []).append(i)
        for keyword, own in by.items():
            self.gates.add_word(f" {keyword} ", own)
        self.gates.make_automaton()
        self.base = [(f" {p} ".encode(), label) for p, label in BASE]

    def __call__(self, words: list[bytes]):
        """([(start, end, kind, weight, label)], [(start, label)]) in words."""
        line = b" " + b" ".join(words) + b" "
        gated: set[int] = set()
        for _, own in self.gates.iter(line.decode("latin-1")):
            gated.update(own)
        spans, which = [], []
        for i in sorted(gated):
            for m in self.rules[i][4].finditer(line):
                spans.append(m.span())
                which.append(i)
        base, labels = [], []
        for phrase, label in self.base:
            at = line.find(phrase)
            while at >= 0:
                base.append(at)
                labels.append(label)
                at = line.find(phrase, at + 1)
        if not spans and not base:
            return [], []
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)  # blank i stands before word i
        place = lambda at: np.searchsorted(blanks, at).tolist()
        words_of = zip(place([a - 1 for a, _ in spans]), place([b for _, b in spans]), which)
        return suppress([(a, b, self.rules[i][0], *self.rules[i][1:3]) for a, b, i in words_of]), list(zip(place(base), labels))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("label", pa.string())])))])
DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start: long, end: long, kind: string, label: string>>"


def scan(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Labels and detections (word spans) of each row; see ``DDL``.

    Null and empty texts have no words, no labels and score 0. Each input row,
    repeated or not, gives one row. The score is the greatest weight of the
    detections and base places, 0 if there are none.
    """

    def run(batches):
        scanner = Scanner()
        for b in batches:
            out = [[] for _ in range(8)]
            for text in b.column(2).to_pylist():
                words = C.alnum_words(text)
                found, base = scanner(words) if words else ([], [])
                at = [p for p, _ in base]
                own = {label for _, label in base}
                score = max([x[3] for x in found] + [SHAPES[-1][1]] * bool(base), default=0.0)
                detections = [{"start": s, "end": e, "kind": SHAPES[k][0], "label": label} for s, e, k, _, label in found]
                row = (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x[4] for x in found})), score, detections)
                for column, value in zip(out, row):
                    column.append(value)
            yield C.batch(_OUT, b.column(0), *out)

    return C.keyed(docs, id_col, text_col).mapInArrow(run, DDL)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(C.read(spark, sf_dir, "documents")).drop("detections")
