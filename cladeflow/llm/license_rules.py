"""Licence signature rules.

Each line of ``RULES`` is ``label | priority | patterns``; patterns are separated by
`` ;; ``. A pattern is a regular expression over lower-case words joined by single
blanks, anchored at a word; its first word is literal. A keyword gates each rule. Words are runs of digits, ASCII letters and characters beyond ASCII, so "2.0"
reads as the words ``2 0`` and "cc-by" as ``cc by``. Priorities: 9 whole grants and
fixed notices, 7 full names with a version, 5 full names, 3 short names and identifiers.
"""

from __future__ import annotations

import re

MAX_WORDS = 24  # no pattern may reach further than this many words

RULES = r"""
apache-2.0 | 9 | licensed under the apache license version 2( 0)? ;; licensed under the terms of the apache license version 2( 0)? ;; released under the apache license version 2( 0)? ;; distributed under the apache license version 2( 0)? ;; available under the apache license version 2( 0)? ;; licensed to the apache software foundation asf under one or more contributor license agreements
apache-2.0 | 7 | apache license version 2( 0)? ;; apache software license version 2( 0)? ;; apache license 2( 0)? ;; apache license v2( 0)? ;; apache public license 2( 0)? ;; asl version 2( 0)?
apache-2.0 | 3 | apache 2( 0)? license ;; apache v2( 0)? license ;; apache license and terms ;; spdx license identifier apache 2 0 ;; asl 2 0 ;; http www apache org licenses license 2 0 ;; https www apache org licenses license 2 0
apache-1.1 | 7 | apache software license version 1 1 ;; apache license version 1 1 ;; apache license 1 1 ;; spdx license identifier apache 1 1
apache-1.0 | 7 | apache software license version 1 0 ;; apache license version 1 0 ;; apache group license 1 0 ;; spdx license identifier apache 1 0
apache | 5 | apache software license ;; apache public license ;; apache style license
mit | 9 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files ;; released under the mit license ;; licensed under the mit license ;; distributed under the mit license ;; available under the mit license ;; licensed under the terms of the mit license ;; subject to the terms of the mit license
mit | 5 | mit license ;; mit x11 license ;; mit expat license ;; expat license ;; x11 license ;; mit style license ;; mit public license
mit | 3 | mit licensed ;; spdx license identifier mit ;; license mit ;; licence mit ;; http opensource org licenses mit ;; https opensource org licenses mit
mit-0 | 7 | mit no attribution( license)? ;; mit 0 license ;; spdx license identifier mit 0
gpl-3.0 | 9 | licensed under the gnu general public license version 3 ;; licensed under the gnu general public license v3 ;; released under the gnu general public license version 3 ;; distributed under the gnu general public license version 3 ;; licensed under the gpl version 3 ;; licensed under the terms of the gnu general public license version 3
gpl-3.0 | 7 | gnu general public license version 3( 0)? ;; gnu general public license v3( 0)? ;; gnu gpl version 3( 0)? ;; gnu gpl v3 ;; gpl version 3( 0)? ;; gnu general public license 3( 0)?
gpl-3.0 | 3 | gplv3 ;; gpl v3 ;; gpl 3( 0)? ;; gpl3 ;; spdx license identifier gpl 3 0( only| or later)? ;; http www gnu org licenses gpl 3 0
gpl-2.0 | 9 | licensed under the gnu general public license version 2 ;; licensed under the gnu general public license v2 ;; released under the gnu general public license version 2 ;; distributed under the gnu general public license version 2 ;; licensed under the gpl version 2
gpl-2.0 | 7 | gnu general public license version 2( 0)? ;; gnu general public license v2( 0)? ;; gnu gpl version 2( 0)? ;; gnu gpl v2 ;; gpl version 2( 0)? ;; gnu general public license 2( 0)?
gpl-2.0 | 3 | gplv2 ;; gpl v2 ;; gpl 2( 0)? ;; gpl2 ;; spdx license identifier gpl 2 0( only| or later)?
gpl-1.0 | 7 | gnu general public license version 1( 0)? ;; gpl version 1 ;; spdx license identifier gpl 1 0( only| or later)?
gpl | 9 | this is free software you can redistribute it and or modify it under the terms of the gnu general public license ;; redistribute it and or modify it under the terms of the gnu general public license ;; licensed under the gnu general public license ;; distributed under the gnu general public license ;; released under the gnu general public license
gpl | 5 | gnu general public license ;; gnu public license ;; gnu gpl ;; general public license ;; gpl license ;; gpl licensed
lgpl-3.0 | 7 | gnu lesser general public license version 3( 0)? ;; gnu lesser general public license v3 ;; gnu lgpl version 3 ;; gnu lgpl v3 ;; lesser general public license version 3( 0)? ;; lgpl version 3( 0)?
lgpl-3.0 | 3 | lgplv3 ;; lgpl v3 ;; lgpl 3( 0)? ;; spdx license identifier lgpl 3 0( only| or later)?
lgpl-2.1 | 7 | gnu lesser general public license version 2 1 ;; gnu lesser general public license v2 1 ;; gnu lgpl version 2 1 ;; gnu lgpl v2 1 ;; lesser general public license version 2 1 ;; lgpl version 2 1
lgpl-2.1 | 3 | lgplv2 1 ;; lgpl v2 1 ;; lgpl 2 1 ;; spdx license identifier lgpl 2 1( only| or later)?
lgpl-2.0 | 7 | gnu library general public license version 2( 0)? ;; gnu lesser general public license version 2 0 ;; lgpl version 2 0 ;; spdx license identifier lgpl 2 0( only| or later)?
lgpl | 9 | redistribute it and or modify it under the terms of the gnu lesser general public license ;; redistribute it and or modify it under the terms of the gnu library general public license ;; licensed under the gnu lesser general public license
lgpl | 5 | gnu lesser general public license ;; gnu library general public license ;; gnu lgpl ;; lesser general public license ;; library general public license ;; lgpl license ;; lgpl licensed
agpl-3.0 | 7 | gnu affero general public license version 3( 0)? ;; gnu affero general public license v3 ;; gnu agpl version 3 ;; affero general public license version 3 ;; agpl version 3 ;; agplv3 ;; agpl v3 ;; agpl 3( 0)? ;; spdx license identifier agpl 3 0( only| or later)?
agpl | 9 | redistribute it and or modify it under the terms of the gnu affero general public license ;; licensed under the gnu affero general public license
agpl | 5 | gnu affero general public license ;; affero general public license ;; gnu agpl ;; agpl license ;; agpl licensed
gfdl-1.3 | 7 | gnu free documentation license version 1 3 ;; gfdl version 1 3 ;; gfdl 1 3 ;; spdx license identifier gfdl 1 3
gfdl-1.2 | 7 | gnu free documentation license version 1 2 ;; gfdl version 1 2 ;; gfdl 1 2 ;; spdx license identifier gfdl 1 2
gfdl | 9 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | 5 | gnu free documentation license ;; free documentation license ;; gfdl licensed
bsd-2-clause | 7 | bsd 2 clause( license)? ;; simplified bsd license ;; freebsd license ;; bsd two clause license ;; spdx license identifier bsd 2 clause ;; two clause bsd license
bsd-3-clause | 7 | bsd 3 clause( license)? ;; new bsd license ;; modified bsd license ;; bsd three clause license ;; revised bsd license ;; spdx license identifier bsd 3 clause ;; three clause bsd license
bsd-3-clause | 9 | neither the name of the copyright holder nor the names of its contributors may be used ;; neither the name of \S+( \S+){0,5} nor the names of its contributors may be used
bsd-4-clause | 7 | bsd 4 clause( license)? ;; original bsd license ;; spdx license identifier bsd 4 clause
bsd-4-clause | 9 | all advertising materials mentioning features or use of this software must display the following acknowledg(e)?ment
bsd | 9 | redistribution and use in source and binary forms with or without modification are permitted
bsd | 5 | bsd license ;; berkeley software distribution license ;; bsd style license ;; bsd licensed ;; bsd licence
isc | 9 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 5 | isc license ;; internet systems consortium license ;; isc licensed ;; spdx license identifier isc ;; isc licence
0bsd | 7 | zero clause bsd( license)? ;; bsd zero clause( license)? ;; 0bsd ;; bsd 0 clause( license)? ;; spdx license identifier 0bsd
mpl-2.0 | 9 | subject to the terms of the mozilla public license v 2 0 ;; subject to the terms of the mozilla public license version 2 0
mpl-2.0 | 7 | mozilla public license version 2( 0)? ;; mozilla public license v 2 0 ;; mozilla public license 2( 0)? ;; mpl version 2 0 ;; mpl 2 0 ;; mplv2( 0)? ;; spdx license identifier mpl 2 0
mpl-1.1 | 9 | subject to the mozilla public license version 1 1
mpl-1.1 | 7 | mozilla public license version 1 1 ;; mozilla public license 1 1 ;; mpl 1 1 ;; mpl version 1 1 ;; spdx license identifier mpl 1 1
mpl | 5 | mozilla public license ;; mpl licensed
epl-2.0 | 7 | eclipse public license version 2( 0)? ;; eclipse public license v 2 0 ;; eclipse public license 2 0 ;; epl 2 0 ;; spdx license identifier epl 2 0
epl-1.0 | 7 | eclipse public license version 1( 0)? ;; eclipse public license v 1 0 ;; eclipse public license 1 0 ;; epl 1 0 ;; spdx license identifier epl 1 0
epl | 5 | eclipse public license ;; eclipse distribution license
cddl-1.0 | 7 | common development and distribution license version 1( 0)? ;; cddl version 1 0 ;; cddl 1 0 ;; spdx license identifier cddl 1 0
cddl-1.1 | 7 | common development and distribution license version 1 1 ;; cddl version 1 1 ;; cddl 1 1 ;; spdx license identifier cddl 1 1
cddl | 5 | common development and distribution license ;; cddl license
cpl-1.0 | 7 | common public license version 1( 0)? ;; cpl 1 0 ;; spdx license identifier cpl 1 0
cpl | 5 | common public license
cc0-1.0 | 9 | dedicated to the public domain under cc0 ;; waived all copyright and related or neighboring rights ;; licensed under cc0
cc0-1.0 | 7 | cc0 1 0( universal)? ;; creative commons zero( v1 0)? ;; creative commons cc0( license)? ;; cc0 license ;; spdx license identifier cc0 1 0 ;; creative commons public domain dedication
cc-by-nc-nd | 9 | licensed under cc by nc nd( [1-4] [0-9])? ;; licensed under a creative commons attribution noncommercial noderivatives ;; licensed under a creative commons attribution noncommercial noderivs
cc-by-nc-nd | 7 | cc by nc nd( [1-4] [0-9])? ;; creative commons attribution noncommercial noderiv(ative)?s( [1-4] [0-9])? ;; creative commons attribution non commercial no derivatives( [1-4] [0-9])?
cc-by-nc-sa | 9 | licensed under cc by nc sa( [1-4] [0-9])? ;; licensed under a creative commons attribution noncommercial sharealike
cc-by-nc-sa | 7 | cc by nc sa( [1-4] [0-9])? ;; creative commons attribution noncommercial sharealike( [1-4] [0-9])? ;; creative commons attribution non commercial share alike( [1-4] [0-9])?
cc-by-nc | 9 | licensed under cc by nc( [1-4] [0-9])? ;; licensed under a creative commons attribution noncommercial
cc-by-nc | 7 | cc by nc( [1-4] [0-9])? ;; creative commons attribution noncommercial( [1-4] [0-9])? ;; creative commons attribution non commercial( [1-4] [0-9])?
cc-by-nd | 9 | licensed under cc by nd( [1-4] [0-9])? ;; licensed under a creative commons attribution noderiv(ative)?s
cc-by-nd | 7 | cc by nd( [1-4] [0-9])? ;; creative commons attribution noderiv(ative)?s( [1-4] [0-9])? ;; creative commons attribution no derivatives( [1-4] [0-9])?
cc-by-sa | 9 | licensed under cc by sa( [1-4] [0-9])? ;; licensed under a creative commons attribution sharealike
cc-by-sa | 7 | cc by sa( [1-4] [0-9])? ;; creative commons attribution sharealike( [1-4] [0-9])? ;; creative commons attribution share alike( [1-4] [0-9])?
cc-by-4.0 | 7 | cc by 4 0 ;; creative commons attribution 4 0( international)? ;; spdx license identifier cc by 4 0
cc-by-3.0 | 7 | cc by 3 0 ;; creative commons attribution 3 0( unported)? ;; spdx license identifier cc by 3 0
cc-by | 9 | licensed under cc by ;; licensed under a creative commons attribution
cc-by | 5 | cc by ;; creative commons attribution( license)? ;; creativecommons org licenses by
creative-commons | 3 | creative commons license ;; creative commons licence
odbl-1.0 | 7 | open database license( odbl)?( v1 0)? ;; odbl 1 0 ;; odbl license ;; odc open database license ;; spdx license identifier odbl 1 0
odc-by-1.0 | 7 | open data commons attribution license ;; odc by 1 0 ;; odc attribution license ;; spdx license identifier odc by 1 0
pddl-1.0 | 7 | public domain dedication and license ;; pddl 1 0 ;; spdx license identifier pddl 1 0
unlicense | 9 | this is free and unencumbered software released into the public domain ;; unencumbered software released into the public domain
unlicense | 5 | unlicense ;; spdx license identifier unlicense
public-domain | 5 | released into the public domain ;; placed in the public domain ;; dedicated to the public domain ;; public domain dedication
wtfpl | 7 | wtfpl( version 2)? ;; do what the fuck you want to public license ;; spdx license identifier wtfpl
zlib | 9 | provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 5 | zlib license ;; zlib libpng license ;; spdx license identifier zlib
libpng | 5 | libpng license ;; spdx license identifier libpng
boost-1.0 | 9 | distributed under the boost software license version 1 0
boost-1.0 | 7 | boost software license version 1 0 ;; boost software license 1 0 ;; bsl 1 0 ;; spdx license identifier bsl 1 0
boost | 5 | boost software license
artistic-2.0 | 7 | artistic license 2 0 ;; artistic license version 2 0 ;; spdx license identifier artistic 2 0
artistic-1.0 | 7 | artistic license 1 0 ;; artistic license version 1 0 ;; spdx license identifier artistic 1 0
artistic | 5 | artistic license
psf-2.0 | 7 | python software foundation license( version 2)? ;; psf license( version 2)? ;; psfl ;; spdx license identifier psf 2 0
ruby | 5 | ruby license ;; spdx license identifier ruby
php-3.01 | 7 | php license version 3 01 ;; php license 3 01 ;; spdx license identifier php 3 01
php | 5 | php license
eupl-1.2 | 7 | european union public licen[cs]e( version)?( v)? 1 2 ;; eupl( v)? 1 2 ;; spdx license identifier eupl 1 2
eupl-1.1 | 7 | european union public licen[cs]e( version)?( v)? 1 1 ;; eupl( v)? 1 1 ;; spdx license identifier eupl 1 1
eupl | 5 | european union public licen[cs]e ;; eupl
cecill-2.1 | 7 | cecill( version)? 2 1 ;; spdx license identifier cecill 2 1
cecill | 5 | cecill license ;; cecill ;; licence cecill
ms-pl | 7 | microsoft public license ;; spdx license identifier ms pl
ms-rl | 7 | microsoft reciprocal license ;; spdx license identifier ms rl
ofl-1.1 | 9 | licensed under the sil open font license version 1 1
ofl-1.1 | 7 | sil open font license( version 1 1)? ;; ofl 1 1 ;; spdx license identifier ofl 1 1
upl-1.0 | 7 | universal permissive license( version 1 0)? ;; spdx license identifier upl 1 0
afl-3.0 | 7 | academic free license( version)?( v)? 3 0 ;; afl 3 0 ;; spdx license identifier afl 3 0
afl | 5 | academic free license
osl-3.0 | 7 | open software license( version)?( v)? 3 0 ;; osl 3 0 ;; spdx license identifier osl 3 0
osl | 5 | open software license
qpl-1.0 | 5 | q public license( version 1 0)? ;; qt public license
sspl-1.0 | 7 | server side public license( version 1)? ;; sspl( v1)? ;; spdx license identifier sspl 1 0
busl-1.1 | 7 | business source license( version)?( 1 1)? ;; busl 1 1 ;; spdx license identifier busl 1 1
elastic-2.0 | 7 | elastic license( version)? 2 0 ;; elastic license v2 ;; spdx license identifier elastic 2 0
openssl | 5 | openssl license ;; spdx license identifier openssl
ncsa | 5 | university of illinois ncsa open source license ;; ncsa open source license ;; spdx license identifier ncsa
vim | 5 | vim license ;; spdx license identifier vim
curl | 5 | curl license ;; spdx license identifier curl
postgresql | 5 | postgresql licen[cs]e ;; spdx license identifier postgresql
unicode | 5 | unicode license( v3)? ;; unicode terms of use
w3c | 5 | w3c software( notice and)? license ;; w3c license ;; spdx license identifier w3c
lppl-1.3c | 7 | latex project public license( version)?( 1 3c?)? ;; lppl( version)? 1 3c? ;; spdx license identifier lppl 1 3c
openrail | 7 | bigscience openrail m ;; creativeml open rail m ;; openrail m license ;; responsible ai license ;; bigscience rail license
llama | 7 | llama [1-9]( [0-9])? community license ;; llama community license agreement
gemma | 5 | gemma terms of use ;; gemma license
proprietary | 5 | all rights reserved ;; proprietary and confidential ;; unauthorized copying of this file
"""


def rules() -> list[tuple[int, str, int, str, str, str]]:
    """(number, label, priority, first word, keyword, pattern) of every rule, in order.

    The keyword, which must occur in a text for the rule to be tried, is the longest word
    that every match of the pattern holds.
    """
    out = []
    for line in RULES.strip().splitlines():
        label, priority, patterns = (x.strip() for x in line.split(" | ", 2))
        for p in map(str.strip, patterns.split(" ;; ")):
            optional = r"[^()]*(\([^()]*\)[^()]*)*\)(\?|\{[^}]*\})"
            # optional words go; a word with an optional part is not literal
            fixed = re.sub(r"\(" + optional, "*", re.sub(r"\( " + optional, "", p)).split()
            literal = [w for w in fixed if re.fullmatch(r"\w+", w)]
            out.append((len(out), label, int(priority), literal[0], max(literal, key=len), p))
    return out
