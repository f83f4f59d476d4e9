"""Signature rules of the license scanner, hand-written, one a line: label | priority | keyword | regular expression.

The expressions run on a text's words, lower-cased and joined by single blanks ("apache-2.0" is "apache 2 0"). A rule
is tried only where its keyword stands in the text, at the start of a word: every match must hold it so. Of detections
that hold one another the higher priority wins, then the longer: one inside a winner is suppressed.
"""

TEXT = r"""
agpl-3.0 | 90 | affero | gnu affero general public license(?: as published by the free software foundation)?(?: either)? version 3
agpl-3.0 | 80 | affero | affero general public license v3
agpl-3.0 | 85 | agpl | spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0 | 70 | agpl | agplv?3
agpl-3.0 | 75 | agpl | agpl (?:version |v )?3(?: 0)?
agpl-1.0 | 80 | affero | affero general public license version 1
agpl | 60 | affero | (?:gnu )?affero general public license
agpl | 40 | agpl | licensed under (?:the )?agpl
lgpl-3.0 | 90 | lesser | gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 3
lgpl-3.0 | 85 | lgpl | spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-3.0 | 70 | lgpl | lgplv?3
lgpl-2.1 | 90 | lesser | gnu lesser general public license(?: as published by the free software foundation)?(?: either)? version 2 1
lgpl-2.1 | 85 | lgpl | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.1 | 70 | lgpl | lgpl ?v?2 1
lgpl-2.0 | 90 | library | gnu library general public license(?: as published by the free software foundation)?(?: either)? version 2
lgpl-2.0 | 85 | lgpl | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl | 60 | lesser | (?:gnu )?lesser general public license
lgpl | 60 | library | (?:gnu )?library general public license
lgpl | 40 | lgpl | licensed under (?:the )?(?:gnu )?lgpl
gpl-3.0 | 85 | general public | gnu general public license(?: as published by the free software foundation)?(?: either)? version 3(?: of the license)?
gpl-3.0 | 85 | gpl | spdx license identifier gpl 3 0(?: only| or later)?
gpl-3.0 | 70 | gpl | gplv3
gpl-3.0 | 70 | gpl | gpl (?:version |v )?3(?: 0)?
gpl-3.0 | 75 | general public | general public license v3
gpl-3.0-or-later | 92 | general public | general public license(?: as published by the free software foundation)?(?: either)? version 3(?: of the license)? or at your option any later version
gpl-2.0-or-later | 92 | general public | general public license(?: as published by the free software foundation)?(?: either)? version 2(?: of the license)? or at your option any later version
gpl-2.0 | 85 | general public | gnu general public license(?: as published by the free software foundation)?(?: either)? version 2(?: of the license)?
gpl-2.0 | 85 | gpl | spdx license identifier gpl 2 0(?: only| or later)?
gpl-2.0 | 70 | gpl | gplv2
gpl-2.0 | 70 | gpl | gpl (?:version |v )?2(?: 0)?
gpl-2.0 | 75 | general public | general public license v2
gpl-2.0-classpath | 95 | classpath | (?:gpl|general public license)[^ ]*(?: [^ ]+){0,30} classpath exception
gpl-1.0 | 80 | general public | general public license version 1(?: 0)?
gpl-1.0 | 85 | gpl | spdx license identifier gpl 1 0(?: only| or later)?
gpl | 40 | gpl | licensed under (?:the )?(?:terms of the )?(?:gnu )?gpl
gpl | 40 | gpl | (?:released|distributed|available) under (?:the )?(?:gnu )?gpl
apache-2.0 | 85 | apache | apache license version 2 0
apache-2.0 | 80 | apache | apache license 2 0
apache-2.0 | 80 | apache | apache software license version 2 0
apache-2.0 | 85 | apache | spdx license identifier apache 2 0
apache-2.0 | 70 | apache | www apache org licenses license 2 0
apache-2.0 | 60 | apache | apache v?2 0 licen[sc]e
apache-2.0 | 60 | apache | licensed under (?:the )?apache 2(?: 0)?
apache-2.0 | 60 | apache | apache license v2(?: 0)?
apache-1.1 | 80 | apache | apache (?:software )?license version 1 1
apache-1.1 | 85 | apache | spdx license identifier apache 1 1
apache-1.0 | 80 | apache | apache (?:software )?license version 1 0
apache-1.0 | 85 | apache | spdx license identifier apache 1 0
apache | 40 | apache | licensed to the apache software foundation
apache | 40 | apache | apache software license
mit | 90 | permission is hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 85 | mit | spdx license identifier mit
mit | 60 | mit | (?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?mit licen[sc]e
mit | 50 | mit | opensource org licenses mit
mit | 50 | mit | (?:licen[sc]e|licensed under) mit
mit | 45 | mit | the mit licen[sc]e mit
mit | 45 | expat | expat licen[sc]e
mit-0 | 90 | mit | mit no attribution
mit-0 | 85 | mit | spdx license identifier mit 0
mit-advertising | 90 | mit | mit license with advertising clause
x11 | 80 | x11 | x11 licen[sc]e
x11 | 85 | x11 | spdx license identifier x11
bsd-2-clause | 85 | bsd | spdx license identifier bsd 2 clause
bsd-2-clause | 70 | bsd | bsd 2 clause
bsd-2-clause | 70 | bsd | (?:2|two) clause bsd
bsd-2-clause | 70 | simplified | simplified bsd licen[sc]e
bsd-2-clause | 70 | freebsd | freebsd licen[sc]e
bsd-3-clause | 85 | bsd | spdx license identifier bsd 3 clause
bsd-3-clause | 70 | bsd | bsd 3 clause
bsd-3-clause | 70 | bsd | (?:3|three) clause bsd
bsd-3-clause | 70 | bsd | (?:new|revised|modified) bsd licen[sc]e
bsd-3-clause | 90 | neither the name | redistribution and use in source and binary forms with or without modification are permitted[a-z0-9 ]{0,900} neither the name
bsd-4-clause | 85 | bsd | spdx license identifier bsd 4 clause
bsd-4-clause | 70 | bsd | (?:4|four) clause bsd
bsd-4-clause | 70 | bsd | original bsd licen[sc]e
bsd-4-clause | 90 | advertising materials | all advertising materials mentioning features or use of this software must display
bsd-0-clause | 85 | 0bsd | spdx license identifier 0bsd
bsd-0-clause | 70 | bsd | (?:0|zero) clause bsd
bsd | 60 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd | 40 | bsd | (?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?bsd licen[sc]e
bsd | 35 | bsd | bsd style licen[sc]e
isc | 85 | isc | spdx license identifier isc
isc | 60 | isc | isc licen[sc]e
isc | 90 | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mpl-2.0 | 85 | mozilla | mozilla public license (?:version |v )?2 0
mpl-2.0 | 85 | mpl | spdx license identifier mpl 2 0
mpl-2.0 | 60 | mpl | mpl (?:v )?2 0
mpl-2.0 | 60 | mozilla | mozilla org mpl 2 0
mpl-1.1 | 85 | mozilla | mozilla public license (?:version |v )?1 1
mpl-1.1 | 85 | mpl | spdx license identifier mpl 1 1
mpl-1.0 | 85 | mozilla | mozilla public license (?:version |v )?1 0
mpl | 50 | mozilla | mozilla public licen[sc]e
epl-2.0 | 85 | eclipse | eclipse public license (?:version |v )?2 0
epl-2.0 | 85 | epl | spdx license identifier epl 2 0
epl-1.0 | 85 | eclipse | eclipse public license (?:version |v )?1 0
epl-1.0 | 85 | epl | spdx license identifier epl 1 0
epl | 50 | eclipse | eclipse public licen[sc]e
edl-1.0 | 80 | eclipse | eclipse distribution license
cddl-1.0 | 85 | cddl | spdx license identifier cddl 1 0
cddl-1.0 | 80 | common development | common development and distribution license(?: cddl)? version 1 0
cddl-1.1 | 85 | cddl | spdx license identifier cddl 1 1
cddl-1.1 | 80 | common development | common development and distribution license(?: cddl)? version 1 1
cddl | 50 | common development | common development and distribution licen[sc]e
cpl-1.0 | 80 | common public | common public license (?:version |v )?1 0
cpl-1.0 | 85 | cpl | spdx license identifier cpl 1 0
ipl-1.0 | 80 | ibm public | ibm public licen[sc]e
eupl-1.2 | 85 | european union | european union public licen[sc]e (?:version |v ?)?1 2
eupl-1.2 | 85 | eupl | spdx license identifier eupl 1 2
eupl-1.1 | 85 | european union | european union public licen[sc]e (?:version |v ?)?1 1
eupl-1.1 | 85 | eupl | spdx license identifier eupl 1 1
eupl | 50 | european union | european union public licen[sc]e
cecill-2.1 | 80 | cecill | cecill (?:free software license agreement )?(?:version |v )?2 1
cecill | 50 | cecill | (?:licence|license) cecill
cecill-b | 70 | cecill | cecill b
cecill-c | 70 | cecill | cecill c
artistic-2.0 | 80 | artistic | artistic license (?:version |v )?2 0
artistic-2.0 | 85 | artistic | spdx license identifier artistic 2 0
artistic-1.0 | 80 | artistic | artistic license (?:version |v )?1 0
artistic | 50 | artistic | artistic licen[sc]e
zlib | 85 | zlib | spdx license identifier zlib
zlib | 60 | zlib | zlib (?:libpng )?licen[sc]e
zlib | 90 | origin of this software | the origin of this software must not be misrepresented
libpng | 60 | libpng | libpng licen[sc]e
boost-1.0 | 85 | boost | boost software license (?:version |v )?1 0
boost-1.0 | 85 | bsl | spdx license identifier bsl 1 0
boost | 50 | boost | boost software licen[sc]e
unlicense | 85 | unlicense | spdx license identifier unlicense
unlicense | 60 | unlicense | (?:the )?unlicense
unlicense | 90 | public domain | this is free and unencumbered software released into the public domain
wtfpl | 85 | wtfpl | spdx license identifier wtfpl
wtfpl | 60 | wtfpl | wtfpl
wtfpl | 90 | do what the | do what the fuck you want to public license
public-domain | 50 | public domain | (?:released|dedicated|placed|donated) (?:in|into|to) the public domain
public-domain | 45 | public domain | this (?:work|file|software|document|text) is in the public domain
public-domain | 60 | public domain | public domain mark(?: 1 0)?
cc0-1.0 | 85 | cc0 | cc0 1 0(?: universal)?
cc0-1.0 | 85 | cc0 | spdx license identifier cc0 1 0
cc0-1.0 | 60 | cc0 | (?:licensed under|creative commons) cc0
cc0-1.0 | 70 | publicdomain zero | creativecommons org publicdomain zero 1 0
cc-by-4.0 | 80 | cc by | cc by 4 0
cc-by-3.0 | 80 | cc by | cc by 3 0
cc-by-2.5 | 80 | cc by | cc by 2 5
cc-by-2.0 | 80 | cc by | cc by 2 0
cc-by-4.0 | 70 | licenses by | creativecommons org licenses by 4 0
cc-by-3.0 | 70 | licenses by | creativecommons org licenses by 3 0
cc-by-4.0 | 75 | attribution | creative commons attribution 4 0(?: international)?
cc-by-3.0 | 75 | attribution | creative commons attribution 3 0(?: unported)?
cc-by | 50 | attribution | creative commons attribution licen[sc]e
cc-by-sa-4.0 | 85 | cc by | cc by sa 4 0
cc-by-sa-3.0 | 85 | cc by | cc by sa 3 0
cc-by-sa-2.5 | 85 | cc by | cc by sa 2 5
cc-by-sa-4.0 | 75 | licenses by | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | 75 | licenses by | creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | 80 | share | creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa-3.0 | 80 | share | creative commons attribution share ?alike 3 0(?: unported)?
cc-by-sa | 60 | cc by | cc by sa
cc-by-sa | 55 | share | attribution share ?alike licen[sc]e
cc-by-nc-4.0 | 85 | cc by | cc by nc 4 0
cc-by-nc-3.0 | 85 | cc by | cc by nc 3 0
cc-by-nc-2.0 | 85 | cc by | cc by nc 2 0
cc-by-nc-4.0 | 75 | licenses by | creativecommons org licenses by nc 4 0
cc-by-nc-4.0 | 80 | creative commons attribution | creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nc-3.0 | 80 | creative commons attribution | creative commons attribution non ?commercial 3 0(?: unported)?
cc-by-nc | 60 | cc by | cc by nc
cc-by-nc-sa-4.0 | 90 | cc by | cc by nc sa 4 0
cc-by-nc-sa-3.0 | 90 | cc by | cc by nc sa 3 0
cc-by-nc-sa-4.0 | 80 | licenses by | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-4.0 | 85 | share | creative commons attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nc-sa | 65 | cc by | cc by nc sa
cc-by-nc-nd-4.0 | 90 | cc by | cc by nc nd 4 0
cc-by-nc-nd-3.0 | 90 | cc by | cc by nc nd 3 0
cc-by-nc-nd-4.0 | 80 | licenses by | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-4.0 | 85 | creative commons attribution | creative commons attribution non ?commercial no ?derivatives 4 0(?: international)?
cc-by-nc-nd | 65 | cc by | cc by nc nd
cc-by-nd-4.0 | 85 | cc by | cc by nd 4 0
cc-by-nd-3.0 | 85 | cc by | cc by nd 3 0
cc-by-nd-4.0 | 75 | licenses by | creativecommons org licenses by nd 4 0
cc-by-nd-4.0 | 80 | creative commons attribution | creative commons attribution no ?derivatives 4 0(?: international)?
cc-by-nd | 60 | cc by | cc by nd
cc | 30 | creative commons | (?:licensed|released|available) under (?:a |the )?creative commons
gfdl-1.3 | 85 | free documentation | gnu free documentation license version 1 3
gfdl-1.3 | 85 | gfdl | spdx license identifier gfdl 1 3(?: only| or later)?
gfdl-1.2 | 85 | free documentation | gnu free documentation license version 1 2
gfdl-1.2 | 85 | gfdl | spdx license identifier gfdl 1 2(?: only| or later)?
gfdl | 50 | free documentation | (?:gnu )?free documentation licen[sc]e
odbl-1.0 | 80 | open database | open database license(?: odbl)?(?: (?:version |v )?1 0)?
odbl-1.0 | 85 | odbl | spdx license identifier odbl 1 0
odc-by-1.0 | 80 | open data commons | open data commons attribution licen[sc]e
pddl-1.0 | 80 | public domain dedication | public domain dedication and licen[sc]e
ofl-1.1 | 80 | open font | sil open font license(?: (?:version |v )?1 1)?
ofl-1.1 | 85 | ofl | spdx license identifier ofl 1 1
python-2.0 | 80 | python | python software foundation license(?: version 2)?
python-2.0 | 85 | python | spdx license identifier python 2 0
psf-2.0 | 85 | psf | spdx license identifier psf 2 0
ruby | 60 | ruby | ruby licen[sc]e
php-3.01 | 80 | php | php license (?:version |v )?3 01
php-3.0 | 80 | php | php license (?:version |v )?3 0
php | 50 | php | php licen[sc]e
perl | 50 | perl | (?:under )?the same terms as perl(?: itself)?
openssl | 60 | openssl | openssl licen[sc]e
ssleay | 60 | ssleay | (?:original )?ssleay licen[sc]e
postgresql | 60 | postgresql | postgresql licen[sc]e
postgresql | 85 | postgresql | spdx license identifier postgresql
ncsa | 60 | ncsa | (?:university of illinois )?ncsa (?:open source )?licen[sc]e
ncsa | 85 | ncsa | spdx license identifier ncsa
ms-pl | 60 | microsoft public | microsoft public licen[sc]e
ms-pl | 85 | ms pl | spdx license identifier ms pl
ms-rl | 60 | microsoft reciprocal | microsoft reciprocal licen[sc]e
osl-3.0 | 80 | open software | open software license (?:version |v )?3 0
osl-3.0 | 85 | osl | spdx license identifier osl 3 0
afl-3.0 | 80 | academic free | academic free license (?:version |v )?3 0
afl-3.0 | 85 | afl | spdx license identifier afl 3 0
qpl-1.0 | 60 | q public | q public licen[sc]e
sleepycat | 60 | sleepycat | sleepycat licen[sc]e
upl-1.0 | 60 | universal permissive | universal permissive licen[sc]e
upl-1.0 | 85 | upl | spdx license identifier upl 1 0
vim | 60 | vim | vim licen[sc]e
w3c | 60 | w3c | w3c (?:software )?(?:notice and )?licen[sc]e
json | 90 | good not evil | the software shall be used for good not evil
beerware | 60 | beer | beer ?ware licen[sc]e
sspl-1.0 | 80 | server side | server side public license(?: (?:version |v )?1)?
sspl-1.0 | 85 | sspl | spdx license identifier sspl 1 0
busl-1.1 | 80 | business source | business source license(?: 1 1)?
busl-1.1 | 85 | busl | spdx license identifier busl 1 1
elastic-2.0 | 80 | elastic | elastic license (?:version |v )?2(?: 0)?
commons-clause | 60 | commons clause | commons clause(?: license condition)?
openrail | 60 | openrail | (?:bigscience |creativeml )?openrail(?: m)? licen[sc]e
openrail | 60 | open rail | (?:bigscience |creativeml )?open rail(?: m)? licen[sc]e
llama-community | 60 | llama | llama (?:2 |3 |3 1 )?community licen[sc]e
proprietary | 40 | all rights reserved | all rights reserved (?:worldwide|no part of this)
proprietary | 45 | proprietary | proprietary and confidential
"""

#: (label, priority, keyword, expression) in the order of the text.
RULES = [tuple(int(x) if x.isdigit() else x for x in map(str.strip, line.split(" | ", 3))) for line in TEXT.strip().splitlines()]
