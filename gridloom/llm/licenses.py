"""License scans by ordered signature rules, with DataFrame functions only.

Each rule is a regular expression over the words of a license notice, with a
one or more keywords, a priority and a confidence. A text is first gated by
strings of which every rule's match holds one; then a rule is tried only if the
text holds one of its keywords. A detection is suppressed if another one of at least its priority
covers its interval (of two equal intervals of equal priority the earlier rule
stays), which one pass in the order of places tells. All of it happens within the
row, so nothing is shuffled.

Most rules are written by hand: sentences that a license is known by (NOTICES)
and names of licenses (NAMED, LICENSES). Around the names of LICENSES there are
also a few forms of a notice (identifier tag, grant, mention).

Defined cases: a null text is empty; a text without phrases has null places, no
labels and score 0; repeated rows are scanned each on its own; other columns
are ignored.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._common import read
from gridloom.llm.spans import bound, quoted, running, spans

#: What separates words, sign by sign: the regular-expression engine looks signs up in a table, but tries ranges one by one.
_SIGNS = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
#: A character of a word of the text as it is; (?i) folds A-Z only.
WORD = f"[^{_SIGNS}]"
APART = f"[{_SIGNS}]+"
#: Phrases of the base scan and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
BASE_SCORE = 0.6

#: Identifier, how the license is named (words; alternatives in brackets), keyword in lower case: a single word, as any signs may stand between two.
LICENSES = (
    ("apache-1.1", "apache (?:software )?licen[cs]e,? (?:version |v)?1[.]1", "apache"),
    ("apache-2.0", "apache (?:software )?licen[cs]e,? (?:version |v)?2(?:[.]0)?", "apache"),
    ("apache", "apache (?:software )?licen[cs]e", "apache"),
    ("mit", "(?:the )?mit (?:open source )?licen[cs]e", "mit"),
    ("mit-0", "mit no attribution(?: licen[cs]e)?", "attribution"),
    ("x11", "(?:mit )?x11 licen[cs]e", "x11"),
    ("isc", "isc licen[cs]e", "isc"),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?", "bsd"),
    ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?", "bsd"),
    ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[cs]e)?", "bsd"),
    ("0bsd", "(?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)?", "bsd"),
    ("bsd", "bsd licen[cs]e", "bsd"),
    ("gpl-1.0", "(?:gnu )?(?:general public licen[cs]e|gpl),? (?:version |v)?1(?:[.]0)?", "general|gpl"),
    ("gpl-2.0", "(?:gnu )?(?:general public licen[cs]e|gpl),? (?:version |v)?2(?:[.]0)?", "general|gpl"),
    ("gpl-3.0", "(?:gnu )?(?:general public licen[cs]e|gpl),? (?:version |v)?3(?:[.]0)?", "general|gpl"),
    ("gpl", "(?:gnu )?(?:general public licen[cs]e|gpl)", "general|gpl"),
    ("lgpl-2.0", "(?:gnu )?(?:library general public licen[cs]e|lgpl),? (?:version |v)?2(?:[.]0)?", "lesser|library|lgpl"),
    ("lgpl-2.1", "(?:gnu )?(?:lesser general public licen[cs]e|lgpl),? (?:version |v)?2[.]1", "lesser|library|lgpl"),
    ("lgpl-3.0", "(?:gnu )?(?:lesser general public licen[cs]e|lgpl),? (?:version |v)?3(?:[.]0)?", "lesser|library|lgpl"),
    ("lgpl", "(?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl)", "lesser|library|lgpl"),
    ("agpl-3.0", "(?:gnu )?(?:affero general public licen[cs]e|agpl),? (?:version |v)?3(?:[.]0)?", "affero|agpl"),
    ("agpl", "(?:gnu )?(?:affero general public licen[cs]e|agpl)", "affero|agpl"),
    ("gfdl-1.3", "(?:gnu )?free documentation licen[cs]e,? (?:version |v)?1[.]3", "documentation"),
    ("gfdl", "(?:gnu )?free documentation licen[cs]e", "documentation"),
    ("mpl-1.1", "mozilla public licen[cs]e,? (?:version |v)?1[.]1", "mozilla"),
    ("mpl-2.0", "mozilla public licen[cs]e,? (?:version |v)?2(?:[.]0)?", "mozilla"),
    ("mpl", "mozilla public licen[cs]e", "mozilla"),
    ("epl-1.0", "eclipse public licen[cs]e,? (?:version |v)?1(?:[.]0)?", "eclipse"),
    ("epl-2.0", "eclipse public licen[cs]e,? (?:version |v)?2(?:[.]0)?", "eclipse"),
    ("epl", "eclipse public licen[cs]e", "eclipse"),
    ("cddl-1.0", "common development and distribution licen[cs]e", "development"),
    ("cpl-1.0", "common public licen[cs]e", "common"),
    ("ms-pl", "microsoft public licen[cs]e", "microsoft"),
    ("ms-rl", "microsoft reciprocal licen[cs]e", "reciprocal"),
    ("artistic-1.0", "artistic licen[cs]e,? (?:version |v)?1(?:[.]0)?", "artistic"),
    ("artistic-2.0", "artistic licen[cs]e,? (?:version |v)?2(?:[.]0)?", "artistic"),
    ("artistic", "artistic licen[cs]e", "artistic"),
    ("bsl-1.0", "boost software licen[cs]e", "boost"),
    ("zlib", "zlib(?: libpng)? licen[cs]e", "zlib"),
    ("unlicense", "(?:the )?unlicen[cs]e", "unlicen"),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", "fuck"),
    ("postgresql", "postgresql licen[cs]e", "postgresql"),
    ("python-2.0", "python (?:software foundation )?licen[cs]e", "python"),
    ("php-3.0", "php licen[cs]e", "php"),
    ("ruby", "ruby licen[cs]e", "ruby"),
    ("openssl", "openssl licen[cs]e", "openssl"),
    ("eupl-1.2", "european union public licen[cs]e", "european"),
    ("ofl-1.1", "(?:sil )?open font licen[cs]e", "font"),
    ("odbl-1.0", "open database licen[cs]e", "database"),
    ("osl-3.0", "open software licen[cs]e", "software"),
    ("afl-3.0", "academic free licen[cs]e", "academic"),
    ("sspl-1.0", "server side public licen[cs]e", "server"),
    ("busl-1.1", "business source licen[cs]e", "business"),
    ("elastic-2.0", "elastic licen[cs]e", "elastic"),
    ("upl-1.0", "universal permissive licen[cs]e", "permissive"),
    ("ncsa", "(?:university of illinois )?ncsa (?:open source )?licen[cs]e", "ncsa"),
    ("cc0-1.0", "(?:creative commons zero|cc0|cc zero)(?: 1[.]0)?", "creative|cc"),
    ("cc-by-nc-nd", "(?:creative commons attribution noncommercial noderiv(?:s|atives)|cc by nc nd)(?: [1-4][.][05])?", "creative|cc"),
    ("cc-by-nc-sa", "(?:creative commons attribution noncommercial sharealike|cc by nc sa)(?: [1-4][.][05])?", "creative|cc"),
    ("cc-by-nc", "(?:creative commons attribution non ?commercial|cc by nc)(?: [1-4][.][05])?", "creative|cc"),
    ("cc-by-nd", "(?:creative commons attribution noderiv(?:s|atives)|cc by nd)(?: [1-4][.][05])?", "creative|cc"),
    ("cc-by-sa", "(?:creative commons attribution sharealike|cc by sa)(?: [1-4][.][05])?", "creative|cc"),
    ("cc-by", "(?:creative commons attribution|cc by)(?: [1-4][.][05])?", "creative|cc"),
)
#: Label, expression and keyword of further licenses that are known by name.
NAMED = (
    ("adobe-glyph", "adobe glyph list license", "adobe"),
    ("adsl", "amazon digital services license", "amazon"),
    ("asl-amazon", "amazon software licen[cs]e", "amazon"),
    ("apsl", "apple public source licen[cs]e", "apple"),
    ("aladdin", "aladdin free public licen[cs]e", "aladdin"),
    ("art-libre", "free art licen[cs]e", "art"),
    ("art-libre", "licence art libre", "libre"),
    ("bittorrent", "bittorrent open source licen[cs]e", "bittorrent"),
    ("blueoak-1.0.0", "blue oak model licen[cs]e", "oak"),
    ("beerware", "(?:the )?beer ?ware licen[cs]e", "beer"),
    ("cc-pdm", "creative commons public domain mark", "domain"),
    ("cdla-permissive", "community data licen[cs]e agreement permissive", "community"),
    ("cdla-sharing", "community data licen[cs]e agreement sharing", "community"),
    ("cecill", "cecill(?: [abc])?(?: free software)? licen[cs]e", "cecill"),
    ("cern-ohl", "cern open hardware licen[cs]e", "cern"),
    ("commons-clause", "commons clause licen[cs]e condition", "commons"),
    ("condor", "condor public licen[cs]e", "condor"),
    ("cpal-1.0", "common public attribution licen[cs]e", "attribution"),
    ("cpol", "code project open licen[cs]e", "project"),
    ("creativeml-openrail-m", "creativeml open ?rail(?: m)? licen[cs]e", "rail"),
    ("curl", "curl licen[cs]e", "curl"),
    ("d-fsl", "german free software licen[cs]e", "german"),
    ("d-fsl", "deutsche freie software lizenz", "lizenz"),
    ("ecl-2.0", "educational community licen[cs]e", "educational"),
    ("efl-2.0", "eiffel forum licen[cs]e", "eiffel"),
    ("entessa", "entessa public licen[cs]e", "entessa"),
    ("erlpl", "erlang public licen[cs]e", "erlang"),
    ("etalab", "licence ouverte(?: etalab)?", "ouverte"),
    ("eula", "end user licen[cs]e agreement", "user"),
    ("fair", "fair(?: source)? licen[cs]e", "fair"),
    ("frameworx", "frameworx open licen[cs]e", "frameworx"),
    ("freetype", "freetype (?:project )?licen[cs]e", "freetype"),
    ("gl2ps", "gl2ps licen[cs]e", "gl2ps"),
    ("hippocratic", "hippocratic licen[cs]e", "hippocratic"),
    ("hpnd", "historical permission notice and disclaimer", "historical"),
    ("ibm-pibs", "ibm powerpc initialization and boot software", "powerpc"),
    ("icu", "icu licen[cs]e", "icu"),
    ("ijg", "independent jpeg group licen[cs]e", "jpeg"),
    ("imagemagick", "imagemagick licen[cs]e", "imagemagick"),
    ("info-zip", "info zip licen[cs]e", "zip"),
    ("intel", "intel (?:simplified software|open source) licen[cs]e", "intel"),
    ("interbase", "interbase public licen[cs]e", "interbase"),
    ("ipa", "ipa font licen[cs]e", "font"),
    ("ipl-1.0", "ibm public licen[cs]e", "ibm"),
    ("json", "json licen[cs]e", "json"),
    ("latex2e", "latex2e licen[cs]e", "latex2e"),
    ("libpng", "libpng licen[cs]e", "libpng"),
    ("libtiff", "libtiff licen[cs]e", "libtiff"),
    ("llama-community", "llama(?: [0-9](?:[.][0-9])?)? community licen[cs]e", "llama"),
    ("lpl", "lucent public licen[cs]e", "lucent"),
    ("lppl", "latex project public licen[cs]e", "latex"),
    ("miros", "miros licen[cs]e", "miros"),
    ("motosoto", "motosoto open source licen[cs]e", "motosoto"),
    ("mulanpsl", "mulan (?:psl|permissive software licen[cs]e)", "mulan"),
    ("multics", "multics licen[cs]e", "multics"),
    ("naumen", "naumen public licen[cs]e", "naumen"),
    ("netscape", "netscape public licen[cs]e", "netscape"),
    ("net-snmp", "net snmp licen[cs]e", "snmp"),
    ("ngpl", "nethack general public licen[cs]e", "nethack"),
    ("nokia", "nokia open source licen[cs]e", "nokia"),
    ("nposl-3.0", "non profit open software licen[cs]e", "profit"),
    ("ntp", "ntp licen[cs]e", "ntp"),
    ("oclc", "oclc research public licen[cs]e", "oclc"),
    ("odc-by", "open data commons attribution licen[cs]e", "commons"),
    ("ogl", "open government licen[cs]e", "government"),
    ("oldap", "open ?ldap public licen[cs]e", "ldap"),
    ("opl", "open publication licen[cs]e", "publication"),
    ("openrail", "open ?rail(?: m)? licen[cs]e", "rail"),
    ("parity", "parity public licen[cs]e", "parity"),
    ("pddl", "public domain dedication and licen[cs]e", "domain"),
    ("polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter|internal use) licen[cs]e", "polyform"),
    ("qpl-1.0", "(?:the )?qt? public licen[cs]e", "public"),
    ("rpl", "reciprocal public licen[cs]e", "reciprocal"),
    ("rpsl", "real ?networks public source licen[cs]e", "networks"),
    ("sgi-b", "sgi free software licen[cs]e", "sgi"),
    ("simpl", "simple public licen[cs]e", "simple"),
    ("sleepycat", "sleepycat licen[cs]e", "sleepycat"),
    ("smlnj", "standard ml of new jersey licen[cs]e", "jersey"),
    ("spl", "sun public licen[cs]e", "sun"),
    ("sugarcrm", "sugarcrm public licen[cs]e", "sugarcrm"),
    ("tcl", "tcl tk? ?licen[cs]e", "tcl"),
    ("unicode", "unicode licen[cs]e", "unicode"),
    ("vim", "vim licen[cs]e", "vim"),
    ("vostrom", "vostrom public licen[cs]e", "vostrom"),
    ("vsl", "vovida software licen[cs]e", "vovida"),
    ("w3c", "w3c software(?: notice)?(?: and document)? licen[cs]e", "w3c"),
    ("wxwindows", "wxwindows library licen[cs]e", "wxwindows"),
    ("xfree86", "xfree86 licen[cs]e", "xfree86"),
    ("ypl", "yahoo public licen[cs]e", "yahoo"),
    ("zimbra", "zimbra public licen[cs]e", "zimbra"),
    ("zpl", "zope public licen[cs]e", "zope"),
)
#: Label, expression, keyword, priority and confidence of sentences that a license or notice is known by.
NOTICES = (
    ("reserved", "all rights reserved", "reserved", 60, 0.6),
    ("reserved", "(?:some|no) rights reserved", "reserved", 60, 0.4),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", "copyright", 40, 0.4),
    ("copyright", "copyright (?:holders?|owners?)", "copyright", 30, 0.3),
    ("copyright", "(?:portions|parts) copyright", "copyright", 35, 0.4),
    ("copyright", "copyrighted (?:material|works?|programs?|software)", "copyrighted", 30, 0.3),
    ("copyright", "copyright notices? (?:and|must|shall|above)", "copyright", 30, 0.3),
    ("copyright", "protected by (?:international )?copyright laws?", "copyright", 35, 0.4),
    ("public-domain", "(?:in|into|to) the public domain", "domain", 70, 0.7),
    ("public-domain", "placed (?:this|the) (?:code|file|work|software) in the public domain", "domain", 75, 0.8),
    ("public-domain", "not subject to copyright protection", "copyright", 72, 0.7),
    ("public-domain", "no copyright is claimed", "copyright", 72, 0.7),
    ("public-domain", "work of the (?:u s|united states) government", "government", 68, 0.6),
    ("unlicense", "free and unencumbered software released into the public domain", "unencumbered", 96, 0.95),
    ("unlicense", "dedicate any and all copyright interest in the software to the public domain", "copyright", 96, 0.95),
    ("cc0-1.0", "waived all copyright and related or neighboring rights", "copyright", 92, 0.9),
    ("cc0-1.0", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives", "affirmer", 94, 0.95),
    ("cc0-1.0", "dedicated the work to the public domain by waiving", "domain", 92, 0.9),
    ("mit", "permission is hereby granted free of charge to any person", "granted", 95, 0.95),
    ("mit", "to deal in the software without restriction", "restriction", 94, 0.9),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", "permission", 94, 0.95),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim", "liable", 93, 0.9),
    ("mit", "the software is provided as is without warranty of any kind express or implied", "warranty", 92, 0.8),
    ("x11", "except as contained in this notice the name(?s:.{0,60})shall not be used in advertising", "advertising", 94, 0.9),
    ("boost", "free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "organization", 96, 0.95),
    ("boost", "unless such copies or derivative works are solely in the form of machine executable object code", "derivative", 96, 0.95),
    ("isc", "permission to use copy modify and or distribute this software", "permission", 95, 0.9),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee", "permission", 95, 0.9),
    ("isc", "the author disclaims all warranties with regard to this software", "warranties", 92, 0.85),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose", "permission", 94, 0.9),
    ("postgresql", "without fee and without a written agreement is hereby granted", "granted", 95, 0.9),
    ("postgresql", "has no obligations to provide maintenance support updates enhancements or modifications", "obligations", 85, 0.7),
    ("bsd", "redistribution and use in source and binary forms", "redistribution", 90, 0.9),
    ("bsd", "redistributions of source code must retain the (?:above )?copyright notice", "redistributions", 91, 0.9),
    ("bsd", "redistributions in binary form must reproduce the (?:above )?copyright notice", "redistributions", 91, 0.9),
    ("bsd", "this software is provided by the (?:regents|authors?|copyright holders?)(?: and contributors)? as is", "provided", 91, 0.9),
    ("bsd-3-clause", "neither the names? of(?s:.{0,120})may be used to endorse or promote products", "endorse", 93, 0.95),
    ("bsd-3-clause", "names? of (?:the|its) (?:contributors|authors?) may not be used to endorse or promote", "endorse", 93, 0.9),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", "advertising", 94, 0.95),
    ("bsd-2-clause-views", "views and conclusions contained in the software and documentation are those of the authors", "conclusions", 93, 0.9),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications", "permission", 95, 0.95),
    ("zlib", "origin of this software must not be misrepresented", "misrepresented", 95, 0.95),
    ("zlib", "altered source versions must be plainly marked as such", "altered", 95, 0.95),
    ("apache-2.0", "you may not use this file except in compliance with the licen[cs]e", "compliance", 95, 0.95),
    ("apache-2.0", "unless required by applicable law or agreed to in writing(?: software)? distributed under the licen[cs]e", "applicable", 95, 0.95),
    ("apache-2.0", "see the licen[cs]e for the specific language governing permissions and limitations", "governing", 95, 0.95),
    ("apache-2.0", "licensed to the apache software foundation", "apache", 90, 0.9),
    ("apache-2.0", "contributor hereby grants to you a perpetual worldwide non exclusive", "contributor", 92, 0.9),
    ("apache-1.1", "this product includes software developed by the apache software foundation", "apache", 92, 0.9),
    ("apache", "see the notice file distributed with this work", "distributed", 80, 0.7),
    ("gpl", "this program is free software you can redistribute it and or modify", "redistribute", 90, 0.9),
    ("gpl", "received a copy of the gnu general public licen[cs]e", "received", 90, 0.9),
    ("gpl", "general public licen[cs]e as published by the free software foundation", "published", 91, 0.9),
    ("gpl", "this program comes with absolutely no warranty", "warranty", 85, 0.8),
    ("gpl-2.0-or-later", "either version 2(?:[.]0)? of the licen[cs]e or (?:at your option )?any later version", "later", 96, 0.95),
    ("gpl-3.0-or-later", "either version 3(?:[.]0)? of the licen[cs]e or (?:at your option )?any later version", "later", 96, 0.95),
    ("gpl-2.0", "under the terms of version 2 of the gnu general public licen[cs]e", "version", 95, 0.95),
    ("gpl-2.0-linking-exception", "as a special exception(?s:.{0,120})permission to link", "permission", 94, 0.8),
    ("gpl-2.0-classpath-exception", "linking this library statically or dynamically with other modules is making a combined work", "linking", 97, 0.95),
    ("gpl-2.0-autoconf-exception", "as a special exception(?s:.{0,160})configure script generated by autoconf", "autoconf", 97, 0.95),
    ("gpl-3.0", "to protect your rights we need to prevent others from denying you these rights", "rights", 94, 0.95),
    ("gpl-2.0", "each licensee is addressed as you", "licensee", 92, 0.8),
    ("lgpl", "this library is free software you can redistribute it and or modify", "redistribute", 91, 0.9),
    ("lgpl", "received a copy of the gnu (?:lesser|library) general public licen[cs]e", "received", 92, 0.9),
    ("lgpl-2.1-or-later", "either version 2[.]1 of the licen[cs]e or (?:at your option )?any later version", "later", 97, 0.95),
    ("lgpl", "work that uses the library", "library", 50, 0.4),
    ("agpl", "received a copy of the gnu affero general public licen[cs]e", "affero", 93, 0.95),
    ("agpl-3.0", "interacting with it remotely through a computer network", "remotely", 95, 0.95),
    ("gfdl", "permission is granted to copy distribute and or modify this document", "permission", 95, 0.95),
    ("gfdl", "with no invariant sections", "invariant", 92, 0.9),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public licen[cs]e", "mozilla", 96, 0.95),
    ("mpl-2.0", "incompatible with secondary licen[cs]es", "secondary", 94, 0.95),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public licen[cs]e", "mozilla", 95, 0.9),
    ("mpl", "software distributed under the licen[cs]e is distributed on an as is basis without warranty of any kind", "basis", 85, 0.7),
    ("epl", "accompanying materials are made available under the terms of the eclipse public licen[cs]e", "eclipse", 95, 0.95),
    ("epl", "any use reproduction or distribution of the program constitutes recipient s acceptance", "recipient", 93, 0.9),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e", "development", 96, 0.95),
    ("cpl-1.0", "accompanying program is provided under the terms of this common public licen[cs]e", "common", 95, 0.95),
    ("ms-pl", "this licen[cs]e governs use of the accompanying software", "governs", 93, 0.9),
    ("ms-rl", "for any file you distribute that contains code from the software", "distribute", 92, 0.85),
    ("artistic", "copyright holder maintains some semblance of artistic control", "semblance", 96, 0.95),
    ("artistic", "make and give away verbatim copies of the (?:standard version|source form)", "verbatim", 92, 0.85),
    ("perl", "(?:under|on) the same terms as perl(?: itself)?", "perl", 90, 0.9),
    ("ruby", "under the same terms as ruby(?: itself)?", "ruby", 88, 0.85),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document", "verbatim", 95, 0.9),
    ("ofl-1.1", "this font software is licensed under the sil open font licen[cs]e", "font", 97, 0.95),
    ("ofl-1.1", "with reserved font name", "reserved", 90, 0.85),
    ("ofl-1.1", "fonts? (?:may|can) be bundled embedded redistributed and or sold", "redistributed", 94, 0.9),
    ("python-2.0", "making python available to licensee on an as is basis", "licensee", 96, 0.95),
    ("python-2.0", "this licen[cs]e agreement is between the python software foundation", "python", 97, 0.95),
    ("openssl", "this product includes software developed by the openssl project", "openssl", 94, 0.9),
    ("openssl", "this product includes cryptographic software written by", "cryptographic", 92, 0.85),
    ("json", "software shall be used for good not evil", "evil", 96, 0.95),
    ("beerware", "you can buy me a beer in return", "beer", 95, 0.95),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", "permission", 96, 0.9),
    ("ijg", "this software is based in part on the work of the independent jpeg group", "jpeg", 94, 0.9),
    ("sspl-1.0", "make the functionality of the program or a modified version available to third parties as a service", "functionality", 96, 0.95),
    ("busl-1.1", "right to copy modify create derivative works redistribute and make non production use", "production", 96, 0.95),
    ("busl-1.1", "additional use grant", "grant", 80, 0.6),
    ("elastic-2.0", "may not provide the software to third parties as a hosted or managed service", "hosted", 96, 0.95),
    ("commons-clause", "grant of rights under the licen[cs]e will not include(?s:.{0,60})right to sell", "sell", 95, 0.95),
    ("ncsa", "neither the names of(?s:.{0,80})nor the names of its contributors may be used to endorse", "endorse", 94, 0.8),
    ("unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", "unicode", 98, 0.95),
    ("cc-by", "this work is licensed under a creative commons", "creative", 78, 0.7),
    ("cc-by", "you must give appropriate credit provide a link to the licen[cs]e", "credit", 88, 0.85),
    ("cc-by-sa", "distribute your contributions under the same licen[cs]e as the original", "contributions", 90, 0.9),
    ("cc-by-nc", "may not use the material for commercial purposes", "commercial", 89, 0.85),
    ("cc-by-nd", "may not distribute the modified material", "modified", 90, 0.9),
    ("odbl-1.0", "contains information from(?s:.{0,80})which is made available here under the open database licen[cs]e", "database", 96, 0.95),
    ("dual", "dual licen[cs]ed under", "dual", 75, 0.7),
    ("dual", "licensed under either of", "either", 75, 0.7),
    ("dual", "at your option any of the following licen[cs]es", "following", 75, 0.6),
    ("proprietary", "proprietary and confidential", "proprietary", 65, 0.7),
    ("proprietary", "confidential and proprietary", "proprietary", 65, 0.7),
    ("proprietary", "unauthori[sz]ed (?:copying|use|distribution|reproduction|disclosure)", "unauthori", 55, 0.6),
    ("proprietary", "contains confidential (?:and proprietary )?information", "confidential", 64, 0.6),
    ("proprietary", "may not be (?:copied|reproduced|distributed|disclosed)(?s:.{0,80})without (?:the )?(?:prior )?(?:express )?written (?:consent|permission)", "written", 66, 0.7),
    ("proprietary", "trade secrets? of", "secret", 62, 0.6),
    ("proprietary", "shall not (?:attempt to )?(?:decompile|disassemble|reverse engineer)", "decompile|disassemble|engineer", 66, 0.7),
    ("proprietary", "subject to (?:a|the terms of a|the terms of the) (?:written |software )?licen[cs]e agreement", "agreement", 63, 0.6),
    ("proprietary", "licen[cs]ed not sold", "sold", 66, 0.7),
    ("proprietary", "not for (?:resale|redistribution)", "resale|redistribution", 58, 0.5),
    ("proprietary", "evaluation (?:copy|licen[cs]e|version)(?: only)?", "evaluation", 56, 0.4),
    ("restricted-rights", "restricted rights legend", "legend", 68, 0.7),
    ("restricted-rights", "government(?: end)? users restricted rights", "rights", 68, 0.7),
    ("restricted-rights", "use duplication or disclosure by the government is subject to restrictions", "duplication", 68, 0.7),
    ("non-commercial", "for non ?commercial use only", "commercial", 60, 0.5),
    ("research-only", "for (?:academic )?research (?:purposes|use) only", "research", 56, 0.5),
    ("patent", "royalty free patent licen[cs]e", "patent", 45, 0.5),
    ("patent", "patents? (?:licen[cs]e|rights|claims|pending)", "patent", 25, 0.3),
    ("patent", "defensive termination", "termination", 45, 0.4),
    ("trademark", "(?:registered )?trademarks? of", "trademark", 22, 0.2),
    ("trademark", "does not grant permission to use the trade names", "trade", 40, 0.4),
    ("contributor-agreement", "contributor licen[cs]e agreement", "contributor", 60, 0.5),
    ("contributor-agreement", "developer(?: s)? certificate of origin", "certificate", 60, 0.5),
    ("license-file", "see (?:the )?(?:file )?licen[cs]e(?: file| txt| md)? for (?:more |further |licen[cs]e )?(?:details|information|terms)", "details|information|terms", 24, 0.3),
    ("license-file", "found in the licen[cs]e file", "found", 24, 0.3),
    ("warranty", "without warranty of any kind", "warranty", 20, 0.2),
    ("warranty", "without any warranty", "warranty", 20, 0.2),
    ("warranty", "merchantability (?:or|and) fitness for a particular purpose", "merchantability", 20, 0.2),
    ("warranty", "in no event shall(?s:.{0,80})be liable", "liable", 20, 0.2),
    ("warranty", "(?:disclaims?|exclud(?:es|ing)) all (?:implied )?warranties", "warranties", 20, 0.2),
    ("warranty", "use (?:it )?at your own risk", "risk", 18, 0.2),
    ("warranty", "provided as is", "provided", 18, 0.2),
)
#: Form of a notice around a license's name, priority, confidence.
FORMS = (
    ("(?:is |are )?(?:licen[cs]ed|released|distributed|available|published|made available) under (?:the )?(?:terms of )?(?:the )?{}", 100, 1.0),
    ("(?:you may|can) (?:use|redistribute|copy)(?s:.{{0,80}}) under (?:the )?(?:terms of )?(?:the )?{}", 98, 0.95),
    ("{}", 80, 0.8),
)
#: What nearly all names of licenses hold.
STEM = "licen"


def _words(body: str) -> str:
    """A blank stands for what separates words; the whole stands between words."""
    apart = body.replace(" ?", f"(?:{APART})?").replace(" ", APART)
    return f"(?i)(?<!{WORD})(?:{apart})(?!{WORD})"


def rules() -> list[dict]:
    """The rules in the order of priority: sentences, names, and the forms around the names of the common licenses."""
    out = [{"label": b, "regex": a, "keyword": k, "priority": p, "confidence": c} for b, a, k, p, c in NOTICES]
    out += [{"label": label, "regex": name, "keyword": k, "priority": 79, "confidence": 0.8} for label, name, k in NAMED]
    for label, name, keyword in LICENSES:
        for form, priority, confidence in FORMS:
            # a license with its version outranks one without
            exact = label[-1].isdigit() or label.endswith(("clause", "-sa", "-nd", "-nc"))
            body = name.replace(",? ", " ")
            out.append({"label": label, "regex": form.format(body), "keyword": keyword, "priority": priority + exact, "confidence": confidence})
        tag = label.replace(".", "[.]").replace("-", " ")
        out.append({"label": label, "regex": f"spdx license identifier {tag}(?: only| or later)?", "keyword": "spdx", "priority": 110 + len(label), "confidence": 1.0})
    out.sort(key=lambda r: -r["priority"])
    return [r | {"at": i, "keyword": r["keyword"].split("|"), "regex": _words(r["regex"]), "holds": holds(r["regex"], r["keyword"])} for i, r in enumerate(out)]


def holds(body: str, keyword: str) -> list[str]:
    """Strings of which every match holds one: the stem that nearly all rules spell out, or the keywords."""
    while (plain := re.sub(r"\([^()]*\)[?*]?", " ", body)) != body:
        body = plain
    return [STEM] if STEM in body else keyword.split("|")


def gate(table: list[dict]) -> list[str]:
    """Strings of which every match of a rule and of a phrase holds one."""
    found = {k for r in table for k in r["holds"]} | {"cc", "general", "reserved"}
    return sorted(k for k in found if not any(o != k and o in k for o in found))


def scan(docs: DataFrame, table: list[dict] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the surviving detections."""
    table = rules() if table is None else table
    t = docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("t"))
    word = quoted(WORD + "+")
    t = t.withColumns({"n_words": F.expr(f"cast(regexp_count(t, {word}) as bigint)"), "low": F.lower("t")})
    t = t.withColumn("gated", reduce(or_, [F.contains("low", F.lit(k)) for k in gate(table)]))
    for k, (phrase, _) in enumerate(BASE):
        regex = quoted(_words(phrase))
        t = t.withColumn(f"p{k}", F.expr(f"CASE WHEN gated AND regexp_like(t, {regex}) THEN split(t, {regex}, -1) END"))
    firsts, lasts, counts, labels = [], [], [], []
    for k, (phrase, label) in enumerate(BASE):
        n = len(phrase.split())
        counts.append(f"coalesce(size(p{k}) - 1, 0)")
        firsts.append(f"cast(regexp_count(p{k}[0], {word}) as bigint)")
        lasts.append(f"n_words - {n} - regexp_count(element_at(p{k}, -1), {word})")
        labels.append(f"CASE WHEN p{k} IS NOT NULL THEN {quoted(label)} END")
    t = t.withColumns({
        "n_base": F.expr(f"cast({' + '.join(f'(CASE WHEN p{k} IS NULL THEN 0 ELSE {c} END)' for k, c in enumerate(counts))} as bigint)"),
        "first_word": F.expr(f"array_min(array({', '.join(firsts)}))"),
        "last_word": F.expr(f"array_max(array({', '.join(lasts)}))"),
        "base": F.expr(f"array_compact(array({', '.join(labels)}))"),
    }).drop("p0", "p1", "p2")
    schema = "array<struct<label:string,regex:string,keyword:array<string>,priority:int,confidence:double,at:int,holds:array<string>>>"
    t = t.withColumn("rules", F.from_json(F.lit(json.dumps(table)), schema))
    own = "'label', r.label, 'priority', r.priority, 'confidence', r.confidence, 'at', r.at, "
    t = t.withColumn("tried", F.expr("CASE WHEN gated THEN filter(rules, r -> exists(r.keyword, k -> contains(low, k)) AND regexp_like(t, r.regex)) END"))
    t = t.withColumn("found", F.expr(f"CASE WHEN size(tried) > 0 THEN flatten(transform(tried, r -> {spans('t', 'r.regex', own)})) END"))
    # in the order of start, the longer first, then the earlier rule, what covers a detection stands before it:
    # the furthest end so far of those of at least its priority, for each priority that the text has
    order = "array_sort(transform(found, d -> struct(d.low AS low, -d.high AS back, d.at AS at, d.priority AS priority, d.label AS label, d.confidence AS confidence, d.high AS high)))"
    ends = f"transform(levels, p -> {bound('transform(s, d -> IF(d.priority >= p, d.high, -1))', 'h', running('h', 'greatest({x}, {y})'))})"
    kept = "filter(s, (d, i) -> i = 0 OR ends[array_position(levels, d.priority) - 1][i - 1] < d.high)"
    kept = bound(order, "s", bound("array_distinct(transform(s, d -> d.priority))", "levels", bound(ends, "ends", kept)))
    t = t.withColumn("detections", F.expr(f"CASE WHEN size(found) > 0 THEN {kept} END"))
    every = "array_sort(array_distinct(concat(base, coalesce(transform(detections, d -> d.label), cast(array() as array<string>)))))"
    score = f"greatest(CASE WHEN size(base) > 0 THEN {BASE_SCORE}D ELSE 0D END, coalesce(array_max(transform(detections, d -> d.confidence)), 0D))"
    return t.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.expr("array_join(array_sort(base), ',')").alias("base_labels"),
        F.expr(f"array_join({every}, ',')").alias("labels"), F.expr(score).alias("score"), "detections",
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).drop("detections")
