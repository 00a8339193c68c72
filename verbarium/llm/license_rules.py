"""The license signature rules.

A rule is a regular expression over a text's words: lower-cased, joined by one
blank. Three tables are written by hand: licenses with the wordings of their names and of
their tags, sentences of license texts and notices, and addresses. NOTICE and TAG, the
wordings around names and tags, are applied to each license; that gives the rules their order: texts
and tags before notices, notices before bare names. Every repeat in a rule is bounded, so
that matching takes neither deep recursion nor more than linear time.
"""

from __future__ import annotations

from dataclasses import dataclass

#: label | keyword every wording has | wordings of the name | words of its SPDX tags
LICENSES = """
mit | licen | (?:the )?mit(?: x11| expat)? licen[cs]e|expat licen[cs]e | mit
mit-0 | mit | mit no attribution(?: licen[cs]e)? | mit 0
x11 | x11 | x11 licen[cs]e | x11
isc | isc | isc licen[cs]e | isc
bsd-2-clause | bsd | (?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e|bsd 2 clause(?: licen[cs]e)? | bsd 2 clause
bsd-3-clause | bsd | (?:new|modified|revised|3 clause|three clause) bsd licen[cs]e|bsd 3 clause(?: licen[cs]e)? | bsd 3 clause
bsd-4-clause | bsd | (?:original|4 clause|four clause) bsd licen[cs]e|bsd 4 clause(?: licen[cs]e)? | bsd 4 clause
bsd-zero-clause | bsd | zero clause bsd(?: licen[cs]e)?|bsd zero clause(?: licen[cs]e)? | 0bsd
bsd | bsd | bsd(?: style)? licen[cs]e | bsd
apache-1.0 | apache | apache(?: software)? licen[cs]e(?: version)? 1 0 | apache 1 0
apache-1.1 | apache | apache(?: software)? licen[cs]e(?: version)? 1 1 | apache 1 1
apache-2.0 | apache | apache(?: software)? licen[cs]e(?: version| v)? ?v?2(?: 0)? | apache 2 0
gpl-1.0 | general public license | (?:gnu )?general public license(?: version| v)? ?v?1(?: 0)? | gpl 1 0
gpl-2.0 | general public license | (?:gnu )?general public license(?: version| v)? ?v?2(?: 0)? | gpl 2 0
gpl-3.0 | general public license | (?:gnu )?general public license(?: version| v)? ?v?3(?: 0)? | gpl 3 0
gpl-2.0-short | gpl | gpl ?v ?2|gpl version 2|gplv2 | gplv2
gpl-3.0-short | gpl | gpl ?v ?3|gpl version 3|gplv3 | gplv3
lgpl-2.0 | general public license | (?:gnu )?library general public license(?: version| v)? ?v?2(?: 0)? | lgpl 2 0
lgpl-2.1 | general public license | (?:gnu )?lesser general public license(?: version| v)? ?v?2 1 | lgpl 2 1
lgpl-3.0 | general public license | (?:gnu )?lesser general public license(?: version| v)? ?v?3(?: 0)? | lgpl 3 0
lgpl | general public license | (?:gnu )?(?:lesser|library) general public license | lgpl
agpl-3.0 | general public license | (?:gnu )?affero general public license(?: version| v)? ?v?3(?: 0)? | agpl 3 0
agpl | general public license | (?:gnu )?affero general public license | agpl
gfdl | documentation license | (?:gnu )?free documentation license | gfdl
mpl-1.1 | mozilla | mozilla public licen[cs]e(?: version| v)? ?1 1 | mpl 1 1
mpl-2.0 | mozilla | mozilla public licen[cs]e(?: version| v)? ?2(?: 0)? | mpl 2 0
mpl | mozilla | mozilla public licen[cs]e | mpl
epl-1.0 | eclipse | eclipse public licen[cs]e(?: version| v)? ?1(?: 0)? | epl 1 0
epl-2.0 | eclipse | eclipse public licen[cs]e(?: version| v)? ?2(?: 0)? | epl 2 0
edl-1.0 | eclipse | eclipse distribution licen[cs]e(?: version| v)? ?1(?: 0)? | bsd 3 clause eclipse
cddl-1.0 | common development | common development and distribution licen[cs]e(?: version)? 1 0 | cddl 1 0
cddl-1.1 | common development | common development and distribution licen[cs]e(?: version)? 1 1 | cddl 1 1
cddl | common development | common development and distribution licen[cs]e | cddl
cpl-1.0 | common public | common public licen[cs]e(?: version| v)?(?: 1 0)? | cpl 1 0
ipl-1.0 | ibm public | ibm public licen[cs]e(?: version| v)?(?: 1 0)? | ipl 1 0
eupl-1.1 | european union | european union public licen[cs]e(?: version| v)? ?1 1 | eupl 1 1
eupl-1.2 | european union | european union public licen[cs]e(?: version| v)? ?1 2 | eupl 1 2
artistic-1.0 | artistic | artistic licen[cs]e(?: version)? 1 0 | artistic 1 0
artistic-2.0 | artistic | artistic licen[cs]e(?: version)? 2 0 | artistic 2 0
artistic | artistic | artistic licen[cs]e | artistic
bsl-1.0 | boost | boost software licen[cs]e(?: version)?(?: 1 0)? | bsl 1 0
zlib | zlib | zlib(?: libpng)? licen[cs]e | zlib
libpng | libpng | libpng licen[cs]e | libpng
unlicense | unlicense | the unlicense|unlicense licen[cs]e | unlicense
wtfpl | public license | do what the f(?:uck)? ?you want to public license | wtfpl
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?(?: public domain dedication)? | cc0 1 0
cc-by-3.0 | creative commons | creative commons attribution 3 0(?: unported| international)? | cc by 3 0
cc-by-4.0 | creative commons | creative commons attribution 4 0(?: international)? | cc by 4 0
cc-by-sa-3.0 | creative commons | creative commons attribution share ?alike 3 0(?: unported)? | cc by sa 3 0
cc-by-sa-4.0 | creative commons | creative commons attribution share ?alike 4 0(?: international)? | cc by sa 4 0
cc-by-nd-4.0 | creative commons | creative commons attribution no ?deriv(?:ative)?s(?: 4 0)? | cc by nd 4 0
cc-by-nc-4.0 | creative commons | creative commons attribution non ?commercial(?: 4 0)? | cc by nc 4 0
cc-by-nc-sa-4.0 | creative commons | creative commons attribution non ?commercial share ?alike(?: 4 0)? | cc by nc sa 4 0
cc-by-nc-nd-4.0 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: 4 0)? | cc by nc nd 4 0
cc | creative commons | creative commons(?: public)? licen[cs]e|creative commons attribution | cc
public-domain | public domain | dedicated to the public domain|placed in the public domain|released into the public domain | pddl 1 0
odbl-1.0 | open database | open database licen[cs]e | odbl 1 0
odc-by-1.0 | open data commons | open data commons attribution licen[cs]e | odc by 1 0
ofl-1.1 | open font | (?:sil )?open font licen[cs]e(?: version)?(?: 1 1)? | ofl 1 1
psf-2.0 | python software | python software foundation licen[cs]e(?: version 2)? | psf 2 0
python-2.0 | python licen | python licen[cs]e(?: 2 0)? | python 2 0
ruby | ruby licen | ruby licen[cs]e | ruby
php-3.01 | php licen | php licen[cs]e(?: version 3 01)? | php 3 01
perl | perl | same terms as perl(?: 5)? itself | artistic 1 0 perl
postgresql | postgresql | postgresql licen[cs]e | postgresql
ncsa | ncsa | (?:university of illinois )?ncsa open source licen[cs]e|university of illinois ncsa licen[cs]e | ncsa
openssl | openssl | openssl licen[cs]e | openssl
sleepycat | sleepycat | sleepycat licen[cs]e | sleepycat
ms-pl | microsoft public | microsoft public licen[cs]e | ms pl
ms-rl | microsoft reciprocal | microsoft reciprocal licen[cs]e | ms rl
afl-3.0 | academic free | academic free licen[cs]e(?: version| v)?(?: 3 0)? | afl 3 0
osl-3.0 | open software license | open software license(?: version| v)?(?: 3 0)? | osl 3 0
apsl-2.0 | apple public | apple public source licen[cs]e(?: version)?(?: 2 0)? | apsl 2 0
qpl-1.0 | q public | q public licen[cs]e(?: version)?(?: 1 0)? | qpl 1 0
spl-1.0 | sun public | sun public licen[cs]e(?: version)?(?: 1 0)? | spl 1 0
npl-1.1 | netscape | netscape public licen[cs]e(?: version)?(?: 1 1)? | npl 1 1
lppl-1.3c | latex project | latex project public licen[cs]e(?: version 1 3c?)? | lppl 1 3c
cecill-2.1 | cecill | cecill(?: free software)?(?: licen[cs]e)?(?: version)?(?: 2 1)? | cecill 2 1
mulan-psl-2.0 | mulan | mulan psl v2|mulan permissive software licen[cs]e(?: version 2)? | mulanpsl 2 0
blueoak-1.0.0 | blue oak | blue oak model licen[cs]e(?: 1 0 0)? | blueoak 1 0 0
upl-1.0 | universal permissive | universal permissive licen[cs]e(?: 1 0)? | upl 1 0
sspl-1.0 | server side | server side public licen[cs]e(?: version)?(?: 1)? | sspl 1 0
busl-1.1 | business source | business source licen[cs]e(?: version)?(?: 1 1)? | busl 1 1
elastic-2.0 | elastic licen | elastic licen[cs]e(?: version)?(?: 2 0)? | elastic 2 0
vim | vim licen | vim licen[cs]e | vim
w3c | w3c | w3c software(?: notice and)?(?: and document)? licen[cs]e | w3c
unicode | unicode licen | unicode licen[cs]e(?: v3)? | unicode 3 0
curl | curl licen | curl licen[cs]e | curl
ecl-2.0 | educational community | educational community licen[cs]e(?: version)?(?: 2 0)? | ecl 2 0
hpnd | historical permission | historical permission notice and disclaimer | hpnd
json | json licen | json licen[cs]e | json
beerware | beer | beer ?ware licen[cs]e | beerware
openrail | rail | (?:bigscience |creativeml )?open ?rail(?: m)?(?: licen[cs]e)? | openrail
llama-community | community license | llama(?: 2| 3)? community license(?: agreement)? | llama 2
"""

#: label | keyword | a sentence that license texts or headers hold
SENTENCES = """
mit | free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | without restriction | deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
isc | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | source and binary | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | redistributions | redistributions in binary form must reproduce the above copyright notice|redistributions of source code must retain the above copyright notice
bsd-3-clause | endorse or promote | neither the names? of (?:\\S+ ){1,12}may be used to endorse or promote products
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display
apache-2.0 | in compliance with | you may not use this file except in compliance with the license
apache-2.0 | as is | distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2.0 | contributor license | licensed to the apache software foundation asf under one or more contributor license agreements
gpl | redistribute it | this (?:program|library|software) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser |library |affero )?general public license
gpl | will be useful | distributed in the hope that it will be useful but without any warranty
gpl | implied warranty | without even the implied warranty of merchantability or fitness for a particular purpose
gpl-or-later | later version | either version [123](?: \\d)? of the license or at your option any later version
gpl | general public license | you should have received a copy of the gnu (?:lesser |library |affero )?general public license along with this
mpl-2.0 | source code form | this source code form is subject to the terms of the mozilla public license
mpl-1.1 | subject to the | the contents of this file are subject to the mozilla public license
epl | accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse public license
cddl | subject to the | the contents of this file are subject to the terms of the common development and distribution license
bsl-1.0 | free of charge | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
zlib | altered source | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | as is | this software is provided as is without any express or implied warranty
unlicense | unencumbered | this is free and unencumbered software released into the public domain
cc0-1.0 | related or neighboring | waived all copyright and related or neighboring rights
cc | to share | you are free to share copy and redistribute the material
ofl-1.1 | font software | this font software is licensed under the sil open font license
postgresql | paragraph | provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies
openssl | openssl project | this product includes software developed by the openssl project
json | good not evil | the software shall be used for good not evil
beerware | beer | you can buy me a beer in return
proprietary | all rights reserved | all rights reserved
proprietary | confidential | confidential and proprietary information of
noncommercial | non commercial | for non commercial (?:use|purposes) only
warranty-disclaimer | warranty of any | the software is provided as is without warranty of any kind express or implied
mit | portions of the software | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | authors or copyright holders | in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit | action of contract | whether in an action of contract tort or otherwise arising from out of or in connection with the software
mit-0 | persons to whom | sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
x11 | x consortium | the name of the x consortium shall not be used in advertising
x11 | holder shall not be used | except as contained in this notice the names? of (?:the above |a )?copyright holders? shall not be used in advertising
isc | provided that the above | provided that the above copyright notice and this permission notice appear in all copies
isc | author disclaims | the author disclaims all warranties with regard to this software including all implied warranties
isc | loss of use data or profits | whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action
bsd | list of conditions | must retain the above copyright notice this list of conditions and the following disclaimer
bsd | documentation and or other materials | in the documentation and or other materials provided with the distribution
bsd | copyright holders and contributors | this software is provided by the copyright holders and contributors as is
bsd | regents and contributors | this software is provided by the regents and contributors as is
bsd | procurement of substitute | exemplary or consequential damages including but not limited to procurement of substitute goods or services
bsd-3-clause | specific prior written | without specific prior written permission
bsd-4-clause | university of california | this product includes software developed by the university of california berkeley and its contributors
bsd-zero-clause | any purpose with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd-patent | each copyright holder | subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual
apache-2.0 | specific language governing | see the license for the specific language governing permissions and limitations under the license
apache-2.0 | obtain a copy of the license | you may obtain a copy of the license at
apache-2.0 | regarding copyright ownership | see the notice file distributed with this work for additional information regarding copyright ownership
apache-2.0 | grant of patent license | grant of patent license subject to the terms and conditions of this license each contributor hereby grants
apache-2.0 | grant of copyright license | grant of copyright license subject to the terms and conditions of this license each contributor hereby grants
apache-2.0 | conspicuously marked | conspicuously marked or otherwise designated in writing by the copyright owner as not a contribution
apache-1.1 | apache software foundation | this product includes software developed by the apache software foundation
apache-1.1 | products derived from this | products derived from this software may not be called apache
gpl-1.0 | version 1 | under the terms of the gnu general public license as published by the free software foundation either version 1
gpl-2.0 | version 2 | under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2
gpl-3.0 | version 3 | under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3
gpl-2.0-only | version 2 only | general public license version 2 only
gpl-2.0-or-later | or later | general public license(?: version| v) ?2(?: 0)? or later
gpl-3.0-or-later | or later | general public license(?: version| v) ?3(?: 0)? or later
gpl | verbatim copies | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl | freedom to share | the licenses for most software are designed to take away your freedom to share and change it
gpl | freedom to share | intended to guarantee your freedom to share and change (?:free software|all versions of a program)
gpl | free software foundation | write to the free software foundation inc
gpl | corresponding source | the corresponding source for a work in object code form means all the source code
gpl-classpath-exception | classpath exception | gnu general public license version 2 (?:only )?with (?:the )?classpath exception
gpl-classpath-exception | linking this library | linking this library statically or dynamically with other modules is making a combined work based on this library
gpl-linking-exception | special exception | as a special exception (?:if you |you may |the copyright holders )
lgpl | work that uses the library | work that uses the library
lgpl | lesser general public license | gnu lesser general public license for more details
lgpl-2.1 | version 2 1 | gnu lesser general public license as published by the free software foundation either version 2 1
lgpl-3.0 | version 3 | gnu lesser general public license as published by the free software foundation either version 3
agpl | remote network interaction | remote network interaction use with the gnu general public license
agpl-3.0 | affero general public license | gnu affero general public license as published by the free software foundation either version 3
agpl | interacting with it remotely | users interacting with it remotely through a computer network
gfdl | invariant sections | with no invariant sections(?: with)? no front cover texts
gfdl | free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2.0 | mpl was not distributed | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0 | incompatible with secondary | this source code form is incompatible with secondary licenses
mpl-1.1 | software distributed under the license | software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied
mpl-1.1 | initial developer | the initial developer of the original code is
mpl-tri-license | alternatively the contents | alternatively the contents of this file may be used under the terms of (?:either )?the gnu general public license
epl-1.0 | epl v10 | accompanies this distribution and is available at http www eclipse org legal epl v10
epl-2.0 | secondary licenses | this source code may also be made available under the following secondary licenses
eclipse | eclipse foundation | (?:developed|contributed) (?:by|to) the eclipse foundation
cddl | cddl header | cddl header start
cddl | opensolaris | you can obtain a copy of the license at usr src opensolaris license
cpl-1.0 | common public license | made available under the terms of the common public license
eupl | european commission | licensed under the eupl(?: version 1 [12])? or as soon they will be approved by the european commission
artistic-2.0 | distributor fee | you may distribute your modified version as source either gratis or for a distributor fee
perl | perl itself | you can redistribute it and or modify it under the same terms as perl itself
bsl-1.0 | boost software | distributed under the boost software license version 1 0 see accompanying file
bsl-1.0 | machine executable object code | unless such copies or derivative works are solely in the form of machine executable object code
zlib | altered from any source | this notice may not be removed or altered from any source distribution
zlib | origin of this software | the origin of this software must not be misrepresented you must not claim that you wrote the original software
libpng | png reference library | the png reference library is supplied as is
libpng | group 42 | contributing authors and group 42 inc disclaim all warranties
unlicense | for any purpose commercial | either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means
unlicense | dedicate any and all | the author or authors of this software dedicate any and all copyright interest in the software to the public domain
wtfpl | terms and conditions for copying | terms and conditions for copying distribution and modification 0 you just do what
cc0-1.0 | extent possible under law | to the extent possible under law (?:\\S+ ){1,12}has waived all copyright
cc0-1.0 | this deed | the person who associated a work with this deed has dedicated the work to the public domain
cc-by | appropriate credit | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa | under the same license as | you must distribute your contributions under the same license as the original
cc-by-nc | commercial purposes | you may not use the material for commercial purposes
cc-by-nd | modified material | you may not distribute the modified material
cc-by-sa | creative commons attribution share | this work is licensed under a creative commons attribution share ?alike
cc-by | creative commons attribution | this work is licensed under a creative commons attribution (?:[34] 0 )?(?:international |unported )?license
cc-by-nc-sa | noncommercial share | creative commons attribution noncommercial share ?alike
public-domain | public domain | this (?:work|file|software|code|program) is (?:hereby )?(?:in|released into|placed in) the public domain
public-domain | no copyright is claimed | no copyright is claimed
public-domain | united states government | work of the united states government
public-domain | known copyright | free of known copyright restrictions
odbl-1.0 | this database | this (?:\\S+ ){0,4}database is made available under the open database license
odc-by-1.0 | odc by | any rights in individual contents of the database are licensed under the (?:\\S+ ){0,3}odc by
odbl-1.0 | openstreetmap | openstreetmap contributors
ofl-1.1 | reserved font name | with reserved font name
ofl-1.1 | font software | the font software may be sold as part of a larger software package
ofl-1.1 | font software | neither the font software nor any of its individual components
psf-2.0 | psf is | psf is making python available to licensee on an as is basis
psf-2.0 | python software foundation | this license agreement is between the python software foundation
ruby | ruby | you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices.{0,40}ruby
php-3.01 | php software | this product includes php software freely available from
php-3.01 | php license | this source file is subject to version 3 01? of the php license
postgresql | without a written agreement | without fee and without a written agreement is hereby granted
postgresql | provided hereunder | the software provided hereunder is on an as is basis
ncsa | deal with the software | to deal with the software without restriction including without limitation the rights
openssl | eric young | this product includes cryptographic software written by eric young
sleepycat | complete source code | redistributions in any form must be accompanied by information on how to obtain complete source code
ms-pl | accompanying software | this license governs use of the accompanying software if you use the software you accept this license
afl-3.0 | academic free | licensed under the academic free license version
osl-3.0 | open software license | licensed under the open software license version
lppl-1.3c | latex project | this work may be distributed and or modified under the conditions of the latex project public license
lppl-1.3c | lppl maintenance | this work has the lppl maintenance status maintained
cecill | cecill | this software is governed by the cecill(?: b| c)? license under french law
mulan-psl-2.0 | mulan | you can use this software according to the terms and conditions of the mulan psl v2
upl-1.0 | lrgrwrks | any piece of software and or hardware listed in the lrgrwrks txt file
sspl-1.0 | as a service | making the functionality of the program or modified version available to third parties as a service
busl-1.1 | additional use grant | additional use grant
elastic-2.0 | managed service | you may not provide the software to third parties as a hosted or managed service
commons-clause | commons clause | commons clause license condition
w3c | w3c | permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted.{0,60}w3c
unicode | data files | any person obtaining a copy of (?:data files|the unicode data files) and any associated documentation
curl | use copy modify and distribute | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
hpnd | hereby granted without fee | is hereby granted without fee provided that the above copyright notice appears? in all copies
json | software shall be used | the software shall be used for good
openrail | use based restrictions | use based restrictions
openrail | derivatives of the model | you agree not to use the model or derivatives of the model
llama-community | monthly active users | greater than 700 million monthly active users
llama-community | llama materials | llama materials
gemma-terms | gemma | gemma is provided under and subject to the gemma terms of use
proprietary | trade secrets | (?:contains|constitutes) trade secrets
proprietary | unauthorized | unauthorized (?:copying|use|reproduction|distribution) of (?:this|any)
proprietary | reproduced | no part of this (?:publication|document|book|work) may be reproduced
proprietary | written permission | may not be (?:reproduced|copied|distributed|used) without (?:the )?(?:prior |express )?written permission
proprietary | evaluation | for evaluation purposes only
proprietary | end user license agreement | end user license agreement
proprietary | internal use only | for internal use only
noncommercial | commercial use | (?:commercial use is prohibited|not for commercial use|free for non commercial use)
warranty-disclaimer | as is | (?:this software|the software|this program|this work) is provided as is
warranty-disclaimer | merchantability | implied warranties of merchantability(?: and)? fitness for a particular purpose
warranty-disclaimer | at your own risk | use (?:it |this software )?at your own risk
copyleft-notice | copyleft | this is a copyleft license
dual-license | dual licen | (?:is |are )?dual licensed under
"""

#: label | keyword | words of an address
ADDRESSES = """
mit | opensource | opensource org licen[cs]es? mit
apache-2.0 | www apache org | www apache org licen[cs]es licen[cs]e 2 0
bsd-3-clause | opensource | opensource org licen[cs]es? bsd 3 clause
bsd-2-clause | opensource | opensource org licen[cs]es? bsd 2 clause
gpl | gnu org | gnu org licen[cs]es gpl(?: [123] 0)?
lgpl | gnu org | gnu org licen[cs]es lgpl(?: [123] \\d)?
agpl | gnu org | gnu org licen[cs]es agpl(?: 3 0)?
mpl-2.0 | mozilla | mozilla org mpl 2 0
epl-1.0 | eclipse | eclipse org legal epl v10
epl-2.0 | eclipse | eclipse org legal epl 2 0
bsl-1.0 | boost | www boost org license 1 0
cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
cc-by | creativecommons | creativecommons org licen[cs]es by \\d \\d
cc-by-sa | creativecommons | creativecommons org licen[cs]es by sa \\d \\d
cc-by-nc | creativecommons | creativecommons org licen[cs]es by nc(?: sa| nd)? \\d \\d
cc-by-nd | creativecommons | creativecommons org licen[cs]es by nd \\d \\d
ofl-1.1 | sil org | scripts sil org ofl
unlicense | unlicense | unlicense org
odbl-1.0 | opendatacommons | opendatacommons org licen[cs]es odbl
isc | opensource | opensource org licen[cs]es? isc
gpl-2.0 | gnu org | gnu org licen[cs]es old licen[cs]es gpl 2 0
lgpl-2.1 | gnu org | gnu org licen[cs]es old licen[cs]es lgpl 2 1
gpl | fsf org | fsf org licen[cs]es? licen[cs]es? gpl
gfdl | gnu org | gnu org licen[cs]es fdl
apache-2.0 | opensource | opensource org licen[cs]es? apache 2 0
gpl | opensource | opensource org licen[cs]es? gpl
mpl-2.0 | opensource | opensource org licen[cs]es? mpl 2 0
cddl-1.0 | opensource | opensource org licen[cs]es? cddl
zlib | opensource | opensource org licen[cs]es? zlib
artistic-2.0 | opensource | opensource org licen[cs]es? artistic
cc-by-nc-sa | creativecommons | creativecommons org licen[cs]es by nc sa
cc-by-nc-nd | creativecommons | creativecommons org licen[cs]es by nc nd
public-domain | creativecommons | creativecommons org (?:licen[cs]es publicdomain|publicdomain mark)
odc-by-1.0 | opendatacommons | opendatacommons org licen[cs]es by
pddl-1.0 | opendatacommons | opendatacommons org licen[cs]es pddl
zlib | zlib net | zlib net zlib licen[cs]e
php-3.01 | php net | php net license
wtfpl | wtfpl net | www wtfpl net
curl | curl se | curl se docs copyright
w3c | w3 org | w3 org consortium legal
unicode | unicode org | unicode org (?:copyright|license)
mulan-psl-2.0 | license coscl | license coscl org cn mulanpsl2
cecill | cecill info | cecill info
eupl | joinup | joinup ec europa eu
busl-1.1 | mariadb | mariadb com bsl
elastic-2.0 | elastic co | elastic co licensing
llama-community | llama com | llama com license
"""

#: The base phrases, each with the label it gives.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

TAG = "spdx license identifier (?:{})(?: or later| only)?"
NOTICE = "(?:(?:dual )?licen[cs]ed|released|distributed|available|published|provided|redistributed|covered|governed)(?: (?:only|as|to|you|freely|for)){{0,4}} (?:under|by|with|according to)(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)? (?:{})"
#: Every text that a rule matches has one of these, whatever its punctuation.
STEMS = ("licen", "spdx", "gpl", "domain", "cc0", "commons", "mulan", "cecill", "rail", "beer", "permitted", "restriction", "endorse", "advertising", "compliance", "basis", "merchantability", "mozilla", "eclipse", "materials", "plainly", "unencumbered", "neighboring", "paragraph", "openssl", "evil", "reserved", "confidential", "commercial", "scripts", "perl", "wtfpl", "clause", "historical", "later version", "public", "attribution", "copyright", "software", "warrant", "permission", "foundation", "distribut", "procurement", "corresponding", "library", "exception", "remotely", "invariant", "developer", "cddl", "executable", "government", "openstreetmap", "unauthorized", "reproduced", "evaluation", "internal", "risk", "grant", "gemma", "llama", "monthly", "functionality", "lrgrwrks", "documentation", "derivatives", "consortium", "joinup", "mariadb", "trade", "png", "whatsoever", "guarantee", "lppl", "provided")


@dataclass(frozen=True)
class Rule:
    """tier: 0 texts and tags, 1 notices and addresses, 2 names, 3 base phrases; a lower one has priority."""

    tier: int
    label: str
    keyword: str
    pattern: str
    base: bool = False


def _rows(table: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ")] for line in table.strip().splitlines()]


def rules() -> list[Rule]:
    """All rules in their order."""
    out: list[Rule] = []
    names = _rows(LICENSES)
    out += [Rule(0, label, key, text) for label, key, text in _rows(SENTENCES)]
    out += [Rule(0, label, "spdx", TAG.format(tag)) for label, _, _, tag in names]
    out += [Rule(1, label, key, address) for label, key, address in _rows(ADDRESSES)]
    out += [Rule(1, label, key, NOTICE.format(name)) for label, key, name, _ in names]
    out += [Rule(2, label, key, name) for label, key, name, _ in names]
    out += [Rule(3, label, phrase, phrase, True) for phrase, label in BASE.items()]
    return out
