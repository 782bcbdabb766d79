"""License detection by ordered signature rules.

A text is normalised to lower-case words. Rules are regular expressions over the words: one for all tags in an SPDX expression, three for each license's names, and over two hundred written
for the wording of grants, conditions and disclaimers. A keyword automaton, whose keys come from the rules themselves, tells which rules are tried at all, and where. Of overlapping
detections, one that lies inside another of the same or a higher priority is suppressed.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import small_batches, utf8

#: The phrases every caller gets, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label | other names. A label with a version also stands for its name before the version.
LICENSES = """
gpl-1.0 | gnu general public license version 1 | gnu gpl v1 | gplv1
gpl-2.0 | gnu general public license version 2 | gnu gpl v2 | gplv2 | gnu gpl version 2
gpl-3.0 | gnu general public license version 3 | gnu gpl v3 | gplv3 | gnu gpl version 3
lgpl-2.0 | gnu library general public license version 2 | lgplv2
lgpl-2.1 | gnu lesser general public license version 2.1 | lgpl v2.1 | lgplv2.1
lgpl-3.0 | gnu lesser general public license version 3 | lgpl v3 | lgplv3
agpl-3.0 | gnu affero general public license version 3 | agpl v3 | agplv3
gfdl-1.2 | gnu free documentation license version 1.2
gfdl-1.3 | gnu free documentation license version 1.3
lgpl | gnu lesser general public license | gnu library general public license
agpl | gnu affero general public license
gfdl | gnu free documentation license
apache-1.0 | apache license version 1.0 | apache license 1.0
apache-1.1 | apache license version 1.1 | apache software license version 1.1
apache-2.0 | apache license version 2.0 | apache license 2.0 | apache 2.0 license | apache software license 2.0
mit | mit license | expat license | mit x11 license
mit-0 | mit no attribution
bsd-2-clause | bsd 2 clause license | simplified bsd license | freebsd license
bsd-3-clause | bsd 3 clause license | new bsd license | modified bsd license | revised bsd license
bsd-4-clause | bsd 4 clause license | original bsd license
0bsd | zero clause bsd license | bsd zero clause license
isc | isc license | internet systems consortium license
mpl-1.0 | mozilla public license version 1.0 | mozilla public license 1.0
mpl-1.1 | mozilla public license version 1.1 | mozilla public license 1.1
mpl-2.0 | mozilla public license version 2.0 | mozilla public license 2.0 | mozilla public license v 2.0
epl-1.0 | eclipse public license version 1.0 | eclipse public license 1.0
epl-2.0 | eclipse public license version 2.0 | eclipse public license 2.0
cddl-1.0 | common development and distribution license version 1.0
cpl-1.0 | common public license version 1.0
eupl-1.1 | european union public licence version 1.1
eupl-1.2 | european union public licence version 1.2
artistic-1.0 | artistic license version 1.0
artistic-2.0 | artistic license version 2.0
bsl-1.0 | boost software license version 1.0 | boost software license
zlib | zlib license | zlib libpng license
unlicense | the unlicense | unlicense org
wtfpl | do what the fuck you want to public license | wtfpl
cc0-1.0 | cc0 1.0 universal | creative commons zero | cc0
cc-by-1.0 | creative commons attribution 1.0 | cc by 1.0
cc-by-2.0 | creative commons attribution 2.0 | cc by 2.0
cc-by-2.5 | creative commons attribution 2.5 | cc by 2.5
cc-by-3.0 | creative commons attribution 3.0 | cc by 3.0
cc-by-4.0 | creative commons attribution 4.0 | cc by 4.0
cc-by-sa-2.0 | creative commons attribution sharealike 2.0 | cc by sa 2.0
cc-by-sa-3.0 | creative commons attribution sharealike 3.0 | cc by sa 3.0
cc-by-sa-4.0 | creative commons attribution sharealike 4.0 | cc by sa 4.0
cc-by-nc-3.0 | creative commons attribution noncommercial 3.0 | cc by nc 3.0
cc-by-nc-4.0 | creative commons attribution noncommercial 4.0 | cc by nc 4.0
cc-by-nd-3.0 | creative commons attribution noderivs 3.0 | cc by nd 3.0
cc-by-nd-4.0 | creative commons attribution noderivatives 4.0 | cc by nd 4.0
cc-by-nc-sa-3.0 | creative commons attribution noncommercial sharealike 3.0 | cc by nc sa 3.0
cc-by-nc-sa-4.0 | creative commons attribution noncommercial sharealike 4.0 | cc by nc sa 4.0
cc-by-nc-nd-3.0 | creative commons attribution noncommercial noderivs 3.0 | cc by nc nd 3.0
cc-by-nc-nd-4.0 | creative commons attribution noncommercial noderivatives 4.0 | cc by nc nd 4.0
cc-by-sa | creative commons attribution sharealike | cc by sa
cc-by-nc | creative commons attribution noncommercial | cc by nc
cc-by-nd | creative commons attribution noderivatives | cc by nd
cc-by-nc-sa | creative commons attribution noncommercial sharealike | cc by nc sa
cc-by-nc-nd | creative commons attribution noncommercial noderivatives | cc by nc nd
public-domain | public domain dedication | released into the public domain | in the public domain
odbl-1.0 | open database license | odbl
pddl-1.0 | public domain dedication and license
ofl-1.1 | sil open font license version 1.1 | sil open font license
psf-2.0 | python software foundation license
php-3.01 | php license version 3.01
postgresql | postgresql license
ms-pl | microsoft public license
ms-rl | microsoft reciprocal license
ncsa | university of illinois ncsa open source license
afl-3.0 | academic free license version 3.0
osl-3.0 | open software license version 3.0
x11 | x11 license
vim | vim license
ruby | ruby license
all-rights-reserved | all rights reserved
"""
#: What precedes a license's name in a notice.
GRANTS = r"(?:licensed|released|distributed|available|provided|published|redistributed?) under (?:the )?(?:terms of )?(?:the )?|under the terms of the "
#: Label | the words that a clause begins with | a pattern for what follows them, which may be missing if it begins with ? (N stands for any words, up to FEW, V for a version).
CLAUSES = r"""
mit | permission is hereby granted free of charge to any person obtaining a copy of this software |
mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software |
mit | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability |
x11 | except as contained in this notice the name | Nshall not be used in advertising
mit-0 | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided |
isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | provided that the above copyright notice
isc | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted |
0bsd | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | the software is provided
hpnd | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted |
postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted |
bsd | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met |
bsd | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer |
bsd | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer |
bsd-3-clause | neither the name of | N(?:nor the names of its contributors )?may be used to endorse or promote products
bsd-3-clause | the names of its contributors may not be used to endorse or promote products |
bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledgement |
bsd-3-clause-clear | no express or implied licenses to any party s patent rights are granted by this license |
bsd-1-clause | redistribution of this software without the above notice is permitted |
ncsa | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers |
apache-2.0 | you may not use this file except in compliance with the license you may obtain a copy of the license at | (?:http|https) www apache org licenses license 2 0
apache-2.0 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis |
apache-2.0 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license |
apache-1.1 | this product includes software developed by the apache software foundation |
gpl | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license |
gpl-2.0 | under the terms of the gnu general public license as published by the free software foundation either version 2 of the license |
gpl-3.0 | under the terms of the gnu general public license as published by the free software foundation either version 3 of the license |
gpl-2.0-only | under the terms of the gnu general public license version 2 as published by the free software foundation |
gpl | this program is distributed in the hope that it will be useful but without any warranty |
gpl | you should have received a copy of the gnu general public license along with this |
gpl-3.0 | the gnu general public license is a free copyleft license for software and other kinds of works |
gpl-2.0 | the licenses for most software are designed to take away your freedom to share and change it |
lgpl | this library is free software you can redistribute it and or modify it under the terms of the gnu | (?:lesser|library) general public license
lgpl | this library is distributed in the hope that it will be useful but without any warranty |
lgpl | you should have received a copy of the gnu lesser general public license along with this |
agpl | under the terms of the gnu affero general public license as published by the free software foundation |
agpl | you should have received a copy of the gnu affero general public license along with this |
agpl-3.0 | your modified version must prominently offer all users interacting with it remotely through a computer network |
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license |
gpl-classpath-exception | linking this library statically or dynamically with other modules is making a combined work based on this library |
gcc-exception-3.1 | gcc runtime library exception |
mpl-2.0 | this source code form is subject to the terms of the mozilla public license v 2 0 |
mpl-1.1 | the contents of this file are subject to the mozilla public license version 1 1 |
mpl-1.0 | the contents of this file are subject to the mozilla public license version 1 0 |
epl | this program and the accompanying materials are made available under the terms of the eclipse public license | ?(?:v ?|version )?V
cpl-1.0 | this program and the accompanying materials are made available under the terms of the common public license |
cddl | the contents of this file are subject to the terms of the common development and distribution license |
eupl | licensed under the eupl | ?(?:version )?V
cecill | this software is governed by the cecill | (?:b |c )?license under french law
apsl | subject to the apple public source license | ?(?:version )?V
bsl-1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation |
zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages |
zlib | altered source versions must be plainly marked as such and must not be misrepresented as being the original software |
libpng | the png reference library is supplied as is |
ijg | this software is based in part on the work of the independent jpeg group |
openssl | this product includes software developed by the openssl project for use in the openssl toolkit |
php-3.01 | this product includes php software freely available from |
psf-2.0 | psf hereby grants licensee a nonexclusive royalty free world wide license |
artistic | the intent of this document is to state the conditions under which a package may be copied |
artistic-2.0 | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms |
ruby | you may make and give away verbatim copies of the source form of the software without restriction |
vim | vim is charityware you can use and copy it as much as you like |
unlicense | this is free and unencumbered software released into the public domain |
unlicense | anyone is free to copy modify publish use compile sell or distribute this software |
wtfpl | you just do what the fuck you want to |
sqlite-blessing | may you do good and not evil may you find forgiveness for yourself |
json | the software shall be used for good not evil |
beerware | as long as you retain this notice you can do whatever you want with this stuff |
bzip2 | julian seward all rights reserved redistribution and use in source and binary forms |
w3c | by obtaining using and or copying this work you the licensee agree that you have read understood and will comply |
unicode | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files |
ofl-1.1 | this font software is licensed under the sil open font license version 1 1 |
ofl-1.1 | permission is hereby granted free of charge to any person obtaining a copy of the font software |
cc0-1.0 | the person who associated a work with this deed has dedicated the work to the public domain |
cc0-1.0 | to the extent possible under law | N(?:has|have) waived all copyright and related or neighboring rights
cc-by | you are free to share copy and redistribute the material in any medium or format |
cc-by | you must give appropriate credit provide a link to the license and indicate if changes were made |
cc-by-sa | if you remix transform or build upon the material you must distribute your contributions under the same license as the original |
cc-by-nc | you may not use the material for commercial purposes |
cc-by-nd | if you remix transform or build upon the material you may not distribute the modified material |
cc-by | this work is licensed under a creative commons attribution | (?:V |unported |international )*license
cc-by-sa | this work is licensed under a creative commons attribution sharealike | (?:V |unported |international )*license
cc-by-nc | this work is licensed under a creative commons attribution noncommercial | (?:V |unported |international )*license
odbl-1.0 | is made available under the open database license |
odc-by | is made available under the open data commons attribution license |
pddl-1.0 | is made available under the public domain dedication and license |
ms-pl | if you use the software you accept this license if you do not accept the license do not use the software |
afl-3.0 | licensed under the academic free license version 3 0 |
osl-3.0 | licensed under the open software license version 3 0 |
sspl-1.0 | server side public license |
busl-1.1 | the business source license | (?:this document|is not an open source license)
elastic-2.0 | you may not provide the software to third parties as a hosted or managed service |
commons-clause | the license does not include and the license does not grant to you the right to sell the software |
proprietary | this software is the confidential and proprietary information of |
proprietary | unauthorized copying of this file via any medium is strictly prohibited |
all-rights-reserved | no part of this publication may be reproduced |
public-domain | this work has been released into the public domain |
public-domain | has been dedicated to the public domain |
warranty-disclaimer | this software is provided by the | Nas is and any express or implied warranties
warranty-disclaimer | in no event shall the | N(?:be )?liable for any
warranty-disclaimer | without even the implied warranty of merchantability or fitness for a particular purpose |
mit | the above copyright notice and this permission notice shall be included in all copies of the software |
mit | permission is granted free of charge to any person obtaining a copy of this |
mit | use of this source code is governed by an mit style license | ?that can be found in
bsd | use of this source code is governed by a bsd style license | ?that can be found in
bsd | this code is distributed under the terms of the bsd license |
bsd-2-clause | this is licensed under the | (?:simplified|two clause|2 clause) bsd license
bsd-3-clause | this is licensed under the | (?:modified|revised|new|three clause|3 clause) bsd license
bsd-3-clause | the name of the author may not be used to endorse or promote products derived from this software |
bsd-3-clause | nor the names of its contributors may be used to endorse or promote products derived from this software |
bsd-4-clause | this product includes software developed by | Nand its contributors
bsd-4-clause | neither the name of the university nor of the laboratory may be used to endorse or promote products |
bsd-2-clause-patent | subject to the terms and conditions of this license each copyright holder and contributor hereby grants |
bsd-protection | the above copyright notice this list of conditions and the following disclaimer must be retained |
isc | permission to use copy modify and distribute this software for any purpose with or without fee is granted |
hpnd | permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee |
hpnd | that the name of | Nnot be used in advertising or publicity pertaining to distribution
ntp | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted |
curl | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies | N(?:the software is provided as is )?Nexcept as contained in this notice
x11 | other than as expressly provided in this notice the name of |
apache-2.0 | licensed under the apache license version 2 0 the license |
apache-2.0 | see the license for the specific language governing permissions and limitations under the license |
apache-2.0 | licensed to the apache software foundation asf under one or more contributor license agreements |
apache-2.0 | subject to the terms and conditions of this license each contributor hereby grants to you | ?a perpetual
apache-2.0 | derivative works shall mean any work whether in source or object form |
apache-2.0 | you must cause any modified files to carry prominent notices stating that you changed the files |
apache-2.0 | if the work includes a notice text file as part of its distribution |
apache-1.1 | the end user documentation included with the redistribution if any must include the following acknowledgment |
apache-1.0 | this product includes software developed by the apache group for use in the apache http server project |
gpl | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed |
gpl | you may copy and distribute verbatim copies of the program s source code as you receive it |
gpl | if not write to the free software foundation | ?inc
gpl | this is free software you are welcome to redistribute it under certain conditions |
gpl | either version | V(?: )?(?:of the license )?or at your option any later version
gpl-2.0 | you may modify your copy or copies of the program or any portion of it thus forming a work based on the program |
gpl-2.0 | activities other than copying distribution and modification are not covered by this license they are outside its scope |
gpl-2.0-or-later | version 2 of the license or at your option any later version |
gpl-3.0-or-later | version 3 of the license or at your option any later version |
gpl-2.0 | this file is subject to the terms and conditions of version 2 of the gnu general public license |
gpl-3.0 | no covered work shall be deemed part of an effective technological measure |
gpl-3.0 | to propagate a work means to do anything with it that without permission would make you directly or secondarily liable |
gpl-3.0 | you may convey verbatim copies of the program s source code as you receive it |
gpl-linking-exception | as a special exception | N(?:permission to link|link the|linking)
gpl-bison-exception | as a special exception you may create a larger work that contains part or all of the bison parser skeleton |
gpl-autoconf-exception | as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script |
lgpl | under the terms of the gnu lesser general public license as published by the free software foundation | ?either version V
lgpl | under the terms of the gnu library general public license as published by the free software foundation | ?either version V
lgpl-2.1 | this license the lesser general public license applies to some specially designated software packages |
lgpl-3.0 | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 |
agpl-3.0 | the gnu affero general public license is a free copyleft license for software and other kinds of works |
agpl | if you run a modified program on a server and let other users communicate with it there |
gfdl | with no invariant sections no front cover texts and no back cover texts |
gfdl | a copy of the license is included in the section entitled gnu free documentation license |
mpl-2.0 | if a copy of the mpl was not distributed with this file you can obtain one at |
mpl-2.0 | this source code form is incompatible with secondary licenses as defined by the mozilla public license |
mpl-1.1 | software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied |
mpl-1.1 | alternatively the contents of this file may be used under the terms of | (?:either )?the gnu
epl | this program and the accompanying materials are made available under the terms of the eclipse |
epl-1.0 | the accompanying program is provided under the terms of this eclipse public license agreement |
epl-2.0 | this source code may also be made available under the following secondary licenses |
cpl-1.0 | the accompanying program is provided under the terms of this common public license agreement |
ipl-1.0 | the accompanying program is provided under the terms of this ibm public license agreement |
cddl | you may not use this file except in compliance with the license you can obtain a copy of the license at | Ncddl
cddl | when distributing covered code include this cddl header in each file |
eupl | licence for the specific language governing permissions and limitations under the licence |
eupl | this european union public licence applies to the work |
cecill | ce logiciel est regi par la licence cecill |
apsl | this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license |
nokos-1.0 | the contents of this file are subject to the nokos license version |
sissl | the contents of this file are subject to the sun industry standards source license version |
npl | the contents of this file are subject to the netscape public license version | V
cpal-1.0 | the contents of this file are subject to the common public attribution license version |
rpl | unless explicitly acquired and licensed from licensor under another license |
qpl-1.0 | this file is part of | Nmay be distributed under the terms of the q public license
artistic | the copyright holder maintains some semblance of artistic control over the development of the package |
artistic | you may distribute the programs of this package in object code or executable form |
artistic-2.0 | you may use this package and create and use modified versions for any purpose without restriction |
perl | you can redistribute it and or modify it under the same terms as perl itself |
python | this module is free software and you may distribute it under the same terms as python |
psf-2.0 | all contributions are subject to the python software foundation license |
tcl | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose |
bsl-1.0 | distributed under the boost software license version 1 0 | ?(?:see|N(?:license|http))
bsl-1.0 | the copyright notices in the software and this entire statement including the above license grant |
zlib | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely |
zlib | the origin of this software must not be misrepresented you must not claim that you wrote the original software |
zlib | this notice may not be removed or altered from any source distribution |
libtiff | permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee provided that |
icu | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction | Nprovided that the above copyright notice s
unicode | unicode inc hereby grants the right to freely use the information supplied in this file |
ofl-1.1 | the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself |
ofl-1.1 | with reserved font name |
bitstream-vera | permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this license |
unlicense | in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain |
unlicense | we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors |
cc0-1.0 | you can copy modify distribute and perform the work even for commercial purposes all without asking permission |
cc0-1.0 | affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders |
cc-by | you are free to adapt remix transform and build upon the material for any purpose even commercially |
cc-by | subject to the terms and conditions of this public license the licensor hereby grants you a worldwide royalty free non sublicensable |
cc-by | this is an open access article distributed under the terms of the creative commons attribution | ?license
cc-by | this article is licensed under a creative commons attribution | (?:V )?(?:international )?license
cc-by-nc | this is an open access article distributed under the terms of the creative commons attribution | non ?commercial
cc-by-sa | text is available under the creative commons attribution | share ?alike license
cc-by-nd | you may not distribute the modified material if you remix |
cc-by-nc | to share copy distribute and transmit the work | Nnoncommercial
public-domain | this file is in the public domain | ?so clarified
public-domain | this work is in the public domain |
public-domain | no copyright is claimed | ?in the united states
public-domain | the author disclaims copyright to this source code | ?in place of a legal notice
public-domain | released to the public domain by | N(?:author|authors|holder)
us-government-work | this work is a work of the united states government and is not subject to copyright protection |
nist | this software was developed by employees of the national institute of standards and technology |
odbl-1.0 | any rights in individual contents of the database are licensed under the database contents license |
odc-by | any use of the database or works produced from the database must attribute |
ogl-uk | contains public sector information licensed under the open government licence | ?v?V
etalab | licence ouverte open licence | ?V
sspl-1.0 | if you make the functionality of the program or a modified version available to third parties as a service |
busl-1.1 | effective on the change date or the fourth anniversary of the first publicly available distribution |
polyform | the licensor grants you a copyright license for the software to do everything you might do with the software |
elastic-2.0 | you may not move change disable or circumvent the license key functionality in the software |
openrail | use restrictions you agree not to use the model or derivatives of the model |
llama-community | a license to use reproduce distribute copy create derivative works of and make modifications to the | Nmaterials
proprietary | this document contains proprietary and confidential information | ?of
proprietary | may not be reproduced or transmitted in any form or by any means | Nwithout
proprietary | you may not reverse engineer decompile or disassemble | ?the software
proprietary | this software is licensed not sold |
proprietary | all information contained herein is and remains the property of |
proprietary | use duplication or disclosure by the | (?:u s )?government is subject to restrictions
all-rights-reserved | no part of this work may be reproduced |
all-rights-reserved | reproduction in whole or in part without | (?:written )?permission is prohibited
all-rights-reserved | may not be published broadcast rewritten or redistributed |
all-rights-reserved | tous droits reserves |
all-rights-reserved | alle rechte vorbehalten |
all-rights-reserved | todos los derechos reservados |
warranty-disclaimer | this program is provided as is without warranty of any kind | ?either
warranty-disclaimer | the entire risk as to the quality and performance of the | (?:program|software|work) is with you
warranty-disclaimer | in no event will the | N(?:be )?liable (?:to you )?for
warranty-disclaimer | disclaims all warranties with regard to this software |
warranty-disclaimer | this software is provided as is without express or implied warranty |
warranty-disclaimer | makes no representations about the suitability of this software for any purpose |
"""
#: Words that N may stand for, and words before a license's name that the grant of a notice may take.
FEW, GRANT_WORDS = 40, 8

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("priority", pa.int64())])))])
DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,rule:string,first_word:long,n_words:long,priority:long>>"

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal(text: bytes) -> bytes:
    """The text's words, lower-cased, with one space between them and one at either end."""
    return b" " + b" ".join(text.translate(_WORDS).split()) + b" "


def _name(text: str) -> str:
    return normal(text.encode()).decode().strip()


@lru_cache(1)
def tags() -> tuple[dict[str, str], str]:
    """Labels by the words of their tag, and a pattern for any tag with what may follow it in an expression."""
    own = {_name(label): label for label in (line.split("|")[0].strip() for line in LICENSES.strip().splitlines())}
    any_tag = "|".join(re.escape(t) for t in sorted(own, key=len, reverse=True))
    return own, rf"(?:{any_tag})(?: (?:only|or later))?(?: with(?: (?!or |and )[^ ]+){{1,6}}? exception(?: \d+)*)?(?= )"


@lru_cache(1)
def rules() -> tuple[list[tuple[str, str, int, int, re.Pattern]], ahocorasick.Automaton]:
    """(label, kind, priority, words before a keyword that it may begin with, pattern) in order, and the automaton whose values are a keyword's length, the base label it stands
    for, and the rules it opens. Rule `expression` stands for the tags of all labels behind SPDX-License-Identifier."""
    out, opened = [], {}

    def add(label: str, kind: str, priority: int, before: int, keys: list[str], pattern: str) -> None:
        for key in keys:
            opened.setdefault(f" {key} ", []).append(len(out))
        out.append((label, kind, priority, before, re.compile(pattern)))

    version = r"(?: (?:only|or later|or any later version))?"
    add("", "expression", 100, 0, ["spdx license identifier"], rf" spdx license identifier((?: (?:(?:or|and) )?{tags()[1]})+)(?= )")
    for line in LICENSES.strip().splitlines():
        label, *names = (x.strip() for x in line.split("|"))
        names = [_name(n) for n in names]
        tag = _name(label)
        any_name = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
        add(label, "notice", 90, GRANT_WORDS, names, rf" (?:{GRANTS})(?:{any_name}){version}(?= )")
        add(label, "name", 60 + len(names[0].split()), 0, names, rf" (?:{any_name})(?= )")
        add(label, "file", 50, 1, [tag], rf" (?:license|licence) {re.escape(tag)}(?= )")
    for line in CLAUSES.strip().splitlines():
        label, start, rest = (x.strip() for x in line.split("|", 2))
        pattern = f" (?:{worded(rest.removeprefix('?'))})" if rest else ""
        add(label, "clause", 80, 0, [start], f" {start}{f'(?:{pattern})?' if rest[:1] == '?' else pattern}(?= )")
    automaton = ahocorasick.Automaton()
    base = {f" {phrase} ": label for phrase, label in BASE.items()}
    for key in opened.keys() | base.keys():
        automaton.add_word(key, (len(key), base.get(key), opened.get(key, [])))
    automaton.make_automaton()
    return out, automaton


def worded(rest: str) -> str:
    """The pattern with its N and V written out."""
    return re.sub(r"\bN", lambda _: rf"(?:[^ ]+ ){{0,{FEW}}}?", re.sub(r"V", lambda _: r"(?:\d+(?: \d+)*)", rest))


def uncovered(found: set[tuple[str, str, int, int, int]]) -> list[tuple[str, str, int, int, int]]:
    """Of (label, rule, start, end, priority) those that lie inside none of a higher priority, of the same priority and longer, or equal to it and earlier in
    order of label and rule; in text order.

    A Fenwick tree over starts keeps the furthest end of what was kept at or before each.
    """
    starts = sorted({d[2] for d in found})
    place = {x: k + 1 for k, x in enumerate(starts)}
    furthest, kept = [0] * (len(starts) + 1), []
    for d in sorted(found, key=lambda d: (-d[4], d[2] - d[3], d[2], d[0], d[1])):
        k, reach = place[d[2]], 0
        while k:
            reach = max(reach, furthest[k])
            k &= k - 1
        if reach < d[3]:
            kept.append(d)
            k = place[d[2]]
            while k <= len(starts):
                furthest[k] = max(furthest[k], d[3])
                k += k & -k
    return sorted(kept, key=lambda d: (d[2], d[3], d[0], d[1]))


def detect(words: str) -> list[tuple[str, str, int, int, int]]:
    """(label, rule, start, end, priority) of the detections that are left, in text order; start and end count characters."""
    return _detect(words)[0]


def matches(words: str, rule: tuple, at: int) -> Iterator[tuple[str, str, int, int, int]]:
    """What a rule finds that begins with the space at `at`."""
    label, kind, priority, _, pattern = rule
    if not (m := pattern.match(words, at)):
        return
    if kind != "expression":
        yield label, kind, m.start() + 1, m.end(), priority
        return
    own, any_tag = tags()
    for t in re.compile(f" ({any_tag})").finditer(words, m.start(1), m.end() + 1):
        name = max((x for x in own if f"{t[1]} ".startswith(f"{x} ")), key=len)
        yield own[name], "tag", t.start(1), t.end(1), priority


def _detect(words: str) -> tuple[list[tuple[str, str, int, int, int]], list[tuple[int, str]]]:
    """A rule is tried where one of its keywords stands and at as many words before as it may begin with; nothing bounds how far it reaches but its own words."""
    table, automaton = rules()
    found, places = set(), []
    for last, (size, base, opened) in automaton.iter(words):
        start = last - size + 1
        if base:
            places.append((start, base))
        for k in opened:
            at = start
            for _ in range(table[k][3] + 1):
                found.update(matches(words, table[k], at))
                at = words.rfind(" ", 0, at)
                if at < 0:
                    break
    return uncovered(found), places


def _row(text: bytes) -> tuple:
    plain = normal(text).decode("utf-8", "replace")
    n = plain.count(" ") - 1 if len(plain) > 2 else 0
    found, places = _detect(plain)
    if not found and not places:
        return n, 0, None, None, "", "", 0.0, []
    spaces = [k for k, c in enumerate(plain) if c == " "]  # the k-th word begins behind the k-th
    word = lambda at: bisect.bisect_left(spaces, at)
    at = [word(start) for start, _ in places]
    base = {label for _, label in places}
    detections = [dict(label=label, rule=kind, first_word=word(a - 1), n_words=word(b) - word(a - 1), priority=priority) for label, kind, a, b, priority in found]
    labels = base | {d[0] for d in found}
    score = max([d[4] / 100 for d in found] + [0.5] * bool(base), default=0.0)
    return n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, detections


def scan(docs: DataFrame) -> DataFrame:
    """Detections and their digest for every row of `docs` (doc_id, text; other columns are ignored).

    A null text counts as empty; a text without a detection has empty labels, score 0 and null places. Rows with equal or null doc_id are read one by one. A
    detection that two rules make alike comes once, with the label that sorts first. Time grows with a text's length and its keywords. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(1))
            rows = [_row(data[at[i] : at[i + 1]].tobytes()) for i in range(len(at) - 1)]
            columns = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(SCHEMA)[1:]))], schema=SCHEMA)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DDL)
