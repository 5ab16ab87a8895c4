"""License scans by ordered signature rules, in DataFrame functions only.

Text is reduced to lower-case words with one space between. A rule is a regex over these
words with a keyword, a label, a priority and a confidence. A cheap search for a few
stems in the raw text gates all further work. Behind the gate, a rule's regex runs only
if the words contain its keyword. A detection is suppressed if another one's interval
contains it and is longer, or is the same and has the higher priority. What is left gives
the labels; the score is the largest confidence left.

There is no Python on the executors, no join and no shuffle: rules are literals of fixed
number, and a row's detections are arrays in that row.

Null texts count as empty: no words, no labels, score 0. Repeated rows give a row each.
Ties of place and priority keep the rule that stands first. Columns besides the named
ones are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base phrases.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Fixed rule: what separates words; A-Z are lowered first.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text whose A-Z still stand.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A text without any of these stems or words matches no rule and no base phrase.
STEMS = ("licen", "domain", "commons", "warranty", "redistribution", "reserved", "permission", "confidential", "gemma", "advertising", "endorse", "warranties", "apache", "hereby")
SHORT = ("gpl", "gfdl", "mpl", "cddl", "eupl", "wtfpl", "odbl", "cc0", "bsd", "mulan", "cecill", "rail", "code", "creativeml", "bigscience", "ofl", "cc")
#: Most texts with a short stem have it within a word; this is looked at only behind a short stem.
SHORT_GATE = r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])(?:cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+(?:by|0|zero)|cc0|[la]?gpl|gfdl|mpl|cddl|eupl|wtfpl|odbl|0?[\x00-\x2F\x3A-\x60\x7B-\x7F]*bsd|mulan|cecill|open[\x00-\x2F\x3A-\x60\x7B-\x7F]*rail|big[\x00-\x2F\x3A-\x60\x7B-\x7F]*code|creativeml|bigscience|ofl)"

# Names, hand-written: label; keyword that must occur, where a blank at its front is the edge of a word; regex of the name, over words.
# A name ending in "@" takes a version: the regex of the version, and how the label goes on.
NAMES = (
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e"),
    ("gpl", " gpl", r"(?:gnu )?gpl"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl", "library general", r"(?:gnu )?library general public licen[sc]e"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e"),
    ("agpl", "agpl", r"(?:gnu )?agpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e"),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl"),
    ("apache", "apache", r"apache(?: software)?(?: licen[sc]e)"),
    ("mit", " mit ", r"mit(?: x11)? licen[sc]e"),
    ("mit", "expat", r"expat licen[sc]e"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|two clause|2 clause) bsd(?: licen[sc]e)?|bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:modified|revised|new|three clause|3 clause) bsd(?: licen[sc]e)?|bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original|four clause|4 clause) bsd(?: licen[sc]e)?|bsd 4 clause"),
    ("0bsd", "bsd", r"(?:0 ?bsd|zero clause bsd|bsd zero clause)(?: licen[sc]e)?"),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e"),
    ("isc", " isc licen", r"isc licen[sc]e"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"),
    ("mpl", " mpl", r"mpl"),
    ("epl", "eclipse", r"eclipse public licen[sc]e"),
    ("edl", "eclipse", r"eclipse distribution licen[sc]e"),
    ("cpl", "common public", r"common public licen[sc]e"),
    ("cddl", "common development", r"common development and distribution licen[sc]e"),
    ("cddl", "cddl", r"cddl"),
    ("eupl", "european union", r"european union public licen[sc]e"),
    ("eupl", "eupl", r"eupl"),
    ("artistic", "artistic", r"artistic licen[sc]e"),
    ("artistic-clarified", "clarified artistic", r"clarified artistic licen[sc]e"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e"),
    ("busl", "business source", r"business source licen[sc]e"),
    ("sspl", "server side", r"server side public licen[sc]e"),
    ("elastic", "elastic", r"elastic licen[sc]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", r"(?<!zlib )libpng licen[sc]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public licen[sc]e"),
    ("psf", "python software", r"python software foundation licen[sc]e"),
    ("python", " python licen", r"python licen[sc]e"),
    ("php", " php licen", r"php licen[sc]e"),
    ("ruby", " ruby ", r"ruby licen[sc]e|ruby s licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("openssl", "openssl", r"openssl(?: ssleay)? licen[sc]e"),
    ("curl", " curl licen", r"curl licen[sc]e"),
    ("ncsa", " ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)? licen[sc]e"),
    ("osl", "open software", r"open software licen[sc]e"),
    ("afl", "academic free", r"academic free licen[sc]e"),
    ("ofl", "font", r"(?:sil )?open font licen[sc]e"),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e"),
    ("upl", "universal permissive", r"universal permissive licen[sc]e"),
    ("ecl", "educational community", r"educational community licen[sc]e"),
    ("cecill", "cecill", r"cecill(?: [bc])?(?: free software)?(?: licen[sc]e)?"),
    ("lppl", "latex project", r"latex project public licen[sc]e"),
    ("qpl", "q public", r"q public licen[sc]e"),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e"),
    ("ipl", "ibm public", r"ibm public licen[sc]e"),
    ("apsl", "apple public", r"apple public source licen[sc]e"),
    ("npl", "netscape", r"netscape public licen[sc]e"),
    ("spl", "sun public", r"sun public licen[sc]e"),
    ("rpl", "reciprocal public", r"reciprocal public licen[sc]e"),
    ("mulan-psl", "mulan", r"mulan(?: permissive software)?(?: psl)?(?: licen[sc]e)?"),
    ("blueoak", "blue oak", r"blue oak model licen[sc]e"),
    ("parity", "parity", r"parity public licen[sc]e"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|free trial|internal use) licen[sc]e"),
    ("odbl", "open database", r"open database licen[sc]e"),
    ("odbl", "odbl", r"odbl"),
    ("odc-by", "commons attribution", r"open data commons attribution licen[sc]e"),
    ("pddl", "domain dedication", r"public domain dedication and licen[sc]e"),
    ("openrail", "rail", r"(?:bigscience |creativeml )?(?:big ?code )?open ?rail(?: m)?(?: licen[sc]e)?"),
    ("rail", "responsible ai", r"responsible ai licen[sc]e"),
    ("llama", "llama", r"llama(?: [0-9](?: [0-9])?)? community licen[sc]e"),
    ("gemma", "gemma", r"gemma terms of use"),
    ("proprietary", "proprietary", r"proprietary(?: software)? licen[sc]e|proprietary and confidential"),
    ("all-rights-reserved", "rights reserved", r"all rights reserved"),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain|public domain work"),
    ("cc0", "cc0", r"cc0"),
    ("cc0", " cc 0", r"cc 0"),
    ("cc0", " cc zero", r"cc zero"),
    ("cc0", "creative commons", r"creative commons (?:zero|public domain dedication|cc0)"),
    ("cc-by", " cc by", r"cc by"),
    ("cc-by-sa", " cc by sa", r"cc by sa"),
    ("cc-by-nd", " cc by nd", r"cc by nd"),
    ("cc-by-nc", " cc by nc", r"cc by nc"),
    ("cc-by-nc-sa", " cc by nc sa", r"cc by nc sa"),
    ("cc-by-nc-nd", " cc by nc nd", r"cc by nc nd"),
    ("cc-by", "creative commons", r"creative commons attribution"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?"),
)
# Whole notices, hand-written: label, keyword, regex.
NOTICES = (
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "identifier apache", r"spdx licen[sc]e identifier apache 2 0"),
    ("mit", "identifier mit", r"spdx licen[sc]e identifier mit"),
    ("isc", "identifier isc", r"spdx licen[sc]e identifier isc"),
    ("apache-2.0", "www apache org", r"www apache org licenses license 2 0"),
    ("gpl-or-later", "any later version", r"either version [123] of the licen[sc]e or at your option any later version"),
    ("gpl", "free software foundation", r"gnu general public licen[sc]e as published by the free software foundation"),
    ("gpl", "www gnu org", r"www gnu org licenses (?:old licenses )?gpl"),
    ("lgpl", "www gnu org", r"www gnu org licenses (?:old licenses )?lgpl"),
    ("agpl", "www gnu org", r"www gnu org licenses agpl"),
    ("mpl-2.0", "mozilla org mpl", r"mozilla org mpl 2 0"),
    ("cc", "creativecommons org", r"creativecommons org licenses"),
    ("cc0", "creativecommons org", r"creativecommons org publicdomain zero"),
    ("wtfpl", "wtfpl net", r"www wtfpl net"),
    ("unlicense", "unlicense org", r"unlicense org"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib", "as is", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("boost", "boost org", r"www boost org license 1 0 txt"),
    ("ofl", "scripts sil org", r"scripts sil org ofl"),
    ("no-warranty", "without warranty", r"without warranty of any kind"),
    ("no-warranty", "implied warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("all-rights-reserved", "all rights reserved", r"copyright (?:c )?[0-9]{4}(?: [0-9]{4})? .{0,80}?all rights reserved"),
)
# Sentences of license texts and of the headers that stand in files, hand-written.
SENTENCES = (
    ("mit", "above copyright notice and this permission", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "permit persons to whom", r"permission is hereby granted .{0,400}?to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-0", "furnished to do so the software", r"sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is without warranty"),
    ("x11", "name of the x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", "appear in all copies the software is provided", r"provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties"),
    ("0bsd", "fee is hereby granted the software", r"for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties"),
    ("bsd-2-clause", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided"),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "implied warranties", r"any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-3-clause", "nor the names of", r"neither the (?:name|names) of (?:the )?(?:[^ ]+ ){1,12}?nor the names of (?:its|their|any) contributors may be used to endorse or promote"),
    ("bsd-3-clause-clear", "no express or implied licenses", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-3-clause-no-nuclear", "nuclear facility", r"not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility"),
    ("bsd-4-clause-uc", "developed by the university", r"all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by the university of california"),
    ("apache-2.0", "licensed under the apache license version 2 0", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "obtain a copy of the license at", r"you may obtain a copy of the license at (?:http |https )?www apache org licenses license 2 0"),
    ("apache-2.0", "specific language governing permissions", r"see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "perpetual worldwide non exclusive", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", "contributor license agreements", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "apache software foundation http", r"this product includes software developed by the apache software foundation http www apache org"),
    ("apache-1.0", "apache group for use", r"this product includes software developed by the apache group for use in the apache http server project"),
    ("gpl", "can redistribute it and or modify", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl", "should have received a copy of the gnu general", r"you should have received a copy of the gnu general public licen[sc]e along with this (?:program|library|file|software)"),
    ("gpl", "free software and you are welcome", r"this is free software and you are welcome to redistribute it under certain conditions licen[sc]e"),
    ("gpl-1.0-or-later", "version 1 or at your option", r"general public licen[sc]e as published by the free software foundation either version 1 or at your option any later version"),
    ("gpl-2.0-only", "version 2 as published", r"general public licen[sc]e version 2 as published by the free software foundation"),
    ("gpl-2.0-only", "version 2 of the license as published", r"version 2 of the license as published by the free software foundation"),
    ("gpl-2.0-or-later", "version 2 of the licen", r"either version 2 of the licen[sc]e or at your option any later version"),
    ("gpl-3.0-only", "version 3 of the license as published", r"version 3 of the license as published by the free software foundation"),
    ("gpl-3.0-or-later", "version 3 of the licen", r"either version 3 of the licen[sc]e or at your option any later version"),
    ("gpl-2.0", "version 2 june 1991", r"gnu general public license version 2 june 1991"),
    ("gpl-3.0", "version 3 29 june 2007", r"gnu general public license version 3 29 june 2007"),
    ("gpl", "free copyleft license for", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-with-classpath-exception", "linking this library statically", r"linking this library statically or dynamically with other modules is making a combined work based on this library thus the terms and conditions of the gnu general public license"),
    ("gpl-with-autoconf-exception", "configure scripts generated by autoconf", r"free software foundation gives unlimited permission to copy distribute and modify the configure scripts generated by autoconf"),
    ("gpl-with-bison-exception", "bison parser skeleton", r"you may create a larger work that contains part or all of the bison parser skeleton and distribute that work under terms of your choice so long as that work isn t itself a parser generator .{0,200}?licen[sc]e"),
    ("gpl-with-gcc-exception", "runtime library exception", r"gcc runtime library exception .{0,80}?licen[sc]e"),
    ("gpl-with-linux-syscall-note", "linux syscall note", r"licen[sc]e identifier gpl 2 0(?: only| or later)? with linux syscall note"),
    ("lgpl", "terms of the gnu lesser general", r"redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e"),
    ("lgpl", "terms of the gnu library general", r"redistribute it and or modify it under the terms of the gnu library general public licen[sc]e"),
    ("lgpl", "should have received a copy of the gnu lesser", r"you should have received a copy of the gnu lesser general public licen[sc]e"),
    ("lgpl-2.1", "version 2 1 february 1999", r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-2.0", "version 2 june 1991", r"gnu library general public license version 2 june 1991"),
    ("lgpl-3.0", "version 3 29 june 2007", r"gnu lesser general public license version 3 29 june 2007"),
    ("agpl", "terms of the gnu affero", r"redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("agpl-3.0", "version 3 19 november 2007", r"gnu affero general public license version 3 19 november 2007"),
    ("agpl", "network server software", r"specifically designed to ensure cooperation with the community in the case of network server software .{0,200}?licen[sc]e"),
    ("gfdl", "no invariant sections", r"under the terms of the gnu free documentation licen[sc]e version 1 [123] or any later version published by the free software foundation with no invariant sections"),
    ("gfdl", "sense of freedom", r"the purpose of this license is to make a manual textbook or other functional and useful document free in the sense of freedom"),
    ("mpl-2.0", "subject to the terms of the mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "incompatible with secondary", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla public license version 1 1", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "mozilla public license version 1 0", r"the contents of this file are subject to the mozilla public license version 1 0"),
    ("epl-2.0", "eclipse public license 2 0", r"made available under the terms of the eclipse public license 2 0"),
    ("epl-1.0", "eclipse public license v1 0", r"made available under the terms of the eclipse public license v1 0"),
    ("epl", "this eclipse public license", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("cpl-1.0", "this common public license", r"the accompanying program is provided under the terms of this common public license"),
    ("ipl-1.0", "this ibm public license", r"the accompanying program is provided under the terms of this ibm public license"),
    ("cddl", "common development and distribution", r"the contents of this file are subject to the terms of (?:either )?the (?:gnu general public license version 2 only gpl or the )?common development and distribution license"),
    ("eupl-1.2", "eupl version 1 2", r"licensed under the eupl version 1 2(?: or as soon they will be approved by the european commission)?"),
    ("eupl-1.1", "eupl version 1 1", r"licensed under the eupl version 1 1(?: or as soon they will be approved by the european commission)?"),
    ("artistic-1.0", "artistic control", r"copyright holder maintains some semblance of artistic control over the development of the package .{0,300}?licen[sc]e"),
    ("artistic-2.0", "given free software package", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("perl", "same terms as perl", r"(?:modify it |distributed |licen[sc]ed )under the same terms as perl itself.{0,40}? licen[sc]e"),
    ("bsl-1.0", "person or organization obtaining", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", "origin of this software", r"warranty .{0,600}?the origin of this software must not be misrepresented"),
    ("zlib", "permission is granted to anyone", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("unlicense", "copyright interest", r"dedicate any and all copyright interest in the software to the public domain"),
    ("wtfpl", "you just do what", r"you just do what the fuck you want to public license"),
    ("beerware", "beer ware", r"(?:the )?beer ware licen[sc]e"),
    ("beerware", "buy me a beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return .{0,60}?licen[sc]e"),
    ("json", "used for good not evil", r"the software shall be used for good not evil .{0,80}?warranty"),
    ("postgresql", "without a written agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "documentation for any purpose", r"permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose is hereby granted without fee"),
    ("ntp", "makes no representations", r"makes no representations about the suitability (?:of )?this software for any purpose it is provided as is without express or implied warranty"),
    ("curl", "name of a copyright holder", r"except as contained in this notice the name of a copyright holder shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization of the copyright holder .{0,10}?permission"),
    ("openssl", "use in the openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit .{0,60}?endorse"),
    ("ssleay", "cryptographic software written by eric young", r"this product includes cryptographic software written by eric young eay cryptsoft com .{0,200}?advertising"),
    ("ncsa", "deal with the software", r"to deal with the software without restriction including without limitation the rights to use copy modify merge publish .{0,100}?sublicen[sc]e"),
    ("w3c", "under the w3c software", r"this work is distributed under the w3c software licen[sc]e"),
    ("w3c", "w3c liability", r"w3c liability trademark and document use rules apply .{0,60}?licen[sc]e"),
    ("php-3.0", "this product includes php", r"this product includes php(?: software)? freely available from .{0,60}?permission"),
    ("python-2.0", "psf license agreement", r"psf license agreement for python"),
    ("python-2.0", "python software foundation license version 2", r"python software foundation license version 2"),
    ("cnri-python", "cnri open source", r"cnri open source license agreement"),
    ("ofl-1.1", "licensed under the sil", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl", "reserved font name", r"with reserved font name"),
    ("ubuntu-font", "ubuntu font", r"ubuntu font licen[sc]e"),
    ("bitstream-vera", "bitstream vera", r"bitstream vera (?:fonts )?copyright .{0,200}?permission is hereby granted"),
    ("lppl", "conditions of the latex project", r"this work may be distributed and or modified under the conditions of the latex project public license"),
    ("ms-pl", "microsoft public license ms pl", r"microsoft public license ms pl"),
    ("ms-eula", "microsoft software license terms", r"microsoft software license terms"),
    ("afl-3.0", "licensed under the academic free", r"licensed under the academic free license version 3 0"),
    ("osl-3.0", "licensed under the open software", r"licensed under the open software license version 3 0"),
    ("upl-1.0", "larger works", r"both the software and any larger works .{0,200}?licen[sc]e"),
    ("mulan-psl-2.0", "mulan psl v2", r"licensed under mulan psl v2"),
    ("cecill-2.1", "cecill license under french", r"governed by the cecill license under french law"),
    ("qpl-1.0", "defined by trolltech", r"this file may be distributed under the terms of the q public license as defined by trolltech"),
    ("sspl-1.0", "terms of the server side", r"under the terms of the server side public license version 1"),
    ("elastic-2.0", "elastic license 2 0", r"licensed under the elastic license 2 0"),
    ("busl-1.1", "change date", r"business source license 1 1 .{0,400}?change date"),
    ("commons-clause", "commons clause", r"commons clause licen[sc]e condition"),
    ("commons-clause", "right to sell the software", r"the grant of rights under the license will not include .{0,80}?right to sell the software"),
    ("hippocratic", "hippocratic", r"hippocratic licen[sc]e"),
    ("anti-996", "anti 996", r"anti 996 licen[sc]e"),
    ("vim", "vim licen", r"(?:the )?vim licen[sc]e"),
    ("tcl", " tcl ", r"tcl(?: tk)? licen[sc]e"),
    ("icu", "icu licen", r"icu licen[sc]e"),
    ("unicode", "unicode licen", r"unicode licen[sc]e(?: agreement)?(?: v3)?"),
    ("intel", "intel open source", r"intel open source licen[sc]e"),
    ("ijg", "independent jpeg group", r"independent jpeg group(?: s)?.{0,60}?licen[sc]e"),
    ("ftl", "freetype", r"freetype(?: project)? licen[sc]e"),
    ("imagemagick", "imagemagick", r"imagemagick licen[sc]e"),
    ("libtiff", "libtiff", r"libtiff licen[sc]e"),
    ("zpl", "zope public", r"zope public licen[sc]e"),
    ("sgi-b", "sgi free software", r"sgi free software licen[sc]e"),
    ("motosoto", "motosoto", r"motosoto(?: open source)? licen[sc]e"),
    ("nasa", "nasa open source", r"nasa open source licen[sc]e"),
    ("nokia", "nokia open source", r"nokia open source licen[sc]e"),
    ("sissl", "sun industry standards", r"sun industry standards source licen[sc]e"),
    ("oclc", "oclc research", r"oclc research public licen[sc]e"),
    ("ogl", "open government", r"open government licen[sc]e"),
    ("opl", "open publication", r"open publication licen[sc]e"),
    ("ogtsl", "open group test", r"open group test suite licen[sc]e"),
    ("fal", "free art", r"free art licen[sc]e"),
    ("dsl", "design science", r"design science licen[sc]e"),
    ("odc", "open data commons", r"open data commons"),
    ("cdla-permissive", "community data", r"community data licen[sc]e agreement permissive"),
    ("cdla-sharing", "community data", r"community data licen[sc]e agreement sharing"),
    ("odbl", "made available under the open database", r"this .{0,60}?is made available under the open database license"),
    ("cc", "licensed under a creative commons", r"this work is licensed under a creative commons"),
    ("cc0", "waiving all", r"dedicated the work to the public domain by waiving all of his or her rights"),
    ("pdm", "domain mark", r"public domain mark"),
    ("pdm", "free of known copyright", r"free of known copyright restrictions .{0,60}?public domain"),
    ("public-domain", "the public domain", r"(?:hereby )?(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("us-government-work", "united states government", r"work of the united states government .{0,100}?public domain"),
    ("llama", "meta llama", r"meta llama [0-9](?: [0-9])? community license"),
    ("openrail", "use based restrictions", r"use based restrictions as referenced in .{0,40}?licen[sc]e"),
    ("confidential", "strictly confidential", r"strictly confidential do not (?:copy|distribute|forward)"),
    ("confidential", "proprietary information", r"(?:contains|constitutes) confidential and proprietary information"),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential"),
    ("proprietary", "without the prior written permission", r"may not be (?:reproduced|copied|distributed) .{0,80}?without the prior written permission"),
    ("all-rights-reserved", "some rights", r"some rights reserved"),
)
# Addresses of licenses, hand-written; a dot or slash is a blank here.
ADDRESSES = (
    ("mit", "org licenses mit", r"opensource org licenses mit(?: license)?(?: php| html)?|spdx org licenses mit(?: html)?"),
    ("mit", "com licenses mit", r"choosealicense com licenses mit"),
    ("bsd-2-clause", "org licenses bsd 2", r"(?:opensource|spdx) org licenses bsd 2 clause"),
    ("bsd-3-clause", "org licenses bsd 3", r"(?:opensource|spdx) org licenses bsd 3 clause"),
    ("bsd", "org licenses bsd licen", r"opensource org licenses bsd license(?: php)?"),
    ("apache-2.0", "org licenses apache", r"(?:opensource|spdx) org licenses apache 2 0"),
    ("isc", "org licenses isc", r"(?:opensource|spdx) org licenses isc(?: license)?(?: txt)?"),
    ("mpl-2.0", "org licenses mpl 2", r"(?:opensource|spdx) org licenses mpl 2 0"),
    ("epl-1.0", "epl v10", r"licen[sc]e .{0,60}?eclipse org legal epl v10"),
    ("epl-2.0", "epl 2 0", r"(?:spdx|opensource) org licenses epl 2 0|licen[sc]e .{0,60}?eclipse org legal epl 2 0"),
    ("cddl-1.0", "org licenses cddl", r"(?:opensource|spdx) org licenses cddl 1 0"),
    ("artistic-2.0", "org licenses artistic", r"(?:opensource|spdx) org licenses artistic (?:license )?2 0"),
    ("gpl-2.0", "org licenses gpl 2", r"(?:opensource|spdx|gnu) org licenses gpl 2 0(?: only| or later)?(?: html| txt)?"),
    ("gpl-3.0", "org licenses gpl 3", r"(?:opensource|spdx|gnu) org licenses gpl 3 0(?: only| or later)?(?: html| txt)?"),
    ("gpl-2.0", "org licenses old licenses gpl 2", r"gnu org licenses old licenses gpl 2 0"),
    ("lgpl-2.1", "lgpl 2 1", r"(?:opensource|spdx|gnu) org licenses (?:old licenses )?lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "org licenses lgpl 3", r"(?:opensource|spdx|gnu) org licenses lgpl 3 0(?: only| or later)?"),
    ("agpl-3.0", "org licenses agpl 3", r"(?:opensource|spdx|gnu) org licenses agpl 3 0(?: only| or later)?"),
    ("gfdl", "org licenses fdl", r"gnu org licenses fdl(?: 1 [123])?"),
    ("gfdl", "org copyleft fdl", r"gnu org copyleft fdl .{0,40}?licen[sc]e"),
    ("gpl", "org copyleft gpl", r"gnu org copyleft gpl"),
    ("zlib", "org licenses zlib", r"(?:opensource|spdx) org licenses zlib"),
    ("bsl-1.0", "org licenses bsl", r"(?:opensource|spdx) org licenses bsl 1 0"),
    ("ncsa", "org licenses ncsa", r"(?:opensource|spdx) org licenses ncsa"),
    ("unlicense", "org licenses unlicense", r"(?:opensource|spdx) org licenses unlicense"),
    ("0bsd", "org licenses 0bsd", r"(?:opensource|spdx) org licenses 0bsd"),
    ("postgresql", "org licenses postgresql", r"(?:opensource|spdx) org licenses postgresql"),
    ("ms-pl", "org licenses ms pl", r"(?:opensource|spdx) org licenses ms pl"),
    ("ofl-1.1", "org licenses ofl", r"(?:opensource|spdx) org licenses ofl 1 1"),
    ("osl-3.0", "org licenses osl", r"(?:opensource|spdx) org licenses osl 3 0"),
    ("eupl-1.2", "org licenses eupl", r"(?:opensource|spdx) org licenses eupl 1 2"),
    ("upl-1.0", "org licenses upl", r"(?:opensource|spdx) org licenses upl(?: 1 0)?"),
    ("php-3.01", "php net license 3 01", r"www php net license 3 01"),
    ("python-2.0", "docs python org", r"docs python org 3 license"),
    ("cc-by-4.0", "org licenses by 4", r"creativecommons org licenses by 4 0"),
    ("cc-by-3.0", "org licenses by 3", r"creativecommons org licenses by 3 0"),
    ("cc-by-2.0", "org licenses by 2", r"creativecommons org licenses by 2 0"),
    ("cc-by-sa-4.0", "org licenses by sa 4", r"creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", "org licenses by sa 3", r"creativecommons org licenses by sa 3 0"),
    ("cc-by-sa-2.5", "org licenses by sa 2 5", r"creativecommons org licenses by sa 2 5"),
    ("cc-by-nd-4.0", "org licenses by nd 4", r"creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-4.0", "org licenses by nc 4", r"creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-3.0", "org licenses by nc 3", r"creativecommons org licenses by nc 3 0"),
    ("cc-by-nc-sa-4.0", "org licenses by nc sa 4", r"creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-sa-3.0", "org licenses by nc sa 3", r"creativecommons org licenses by nc sa 3 0"),
    ("cc-by-nc-nd-4.0", "org licenses by nc nd 4", r"creativecommons org licenses by nc nd 4 0"),
    ("cc-by-nc-nd-3.0", "org licenses by nc nd 3", r"creativecommons org licenses by nc nd 3 0"),
    ("cc0-1.0", "publicdomain zero 1 0", r"creativecommons org publicdomain zero 1 0"),
    ("pdm", "publicdomain mark", r"creativecommons org publicdomain mark 1 0"),
    ("odbl-1.0", "org licenses odbl", r"opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by-1.0", "opendatacommons org", r"opendatacommons org licenses by(?: 1 0)?"),
    ("pddl-1.0", "org licenses pddl", r"opendatacommons org licenses pddl(?: 1 0)?"),
    ("polyform", "polyformproject org", r"polyformproject org licenses [a-z]+(?: [a-z]+)? 1 0 0"),
    ("sspl-1.0", "server side public license", r"www mongodb com licensing server side public license"),
    ("elastic-2.0", "elastic co licensing", r"www elastic co licensing elastic license"),
    ("busl-1.1", "mariadb com bsl11", r"mariadb com bsl11 .{0,40}?licen[sc]e"),
    ("openrail", "bigscience", r"huggingface co spaces bigscience license"),
    ("gemma", "ai google dev gemma", r"ai google dev gemma terms"),
)
#: How a name stands in a notice: regex before it, regex behind it, priority, confidence.
FORMS = (
    (r"", r"", 10, 0.5),
    (r"(?:licen[sc]ed|released|distributed|available|covered|provided|made available) under (?:the )?(?:terms of )?(?:the )?", r"", 40, 0.9),
    (r"spdx licen[sc]e identifier ", r"", 60, 1.0),
)
VERSION = r"(?: licen[sc]e)?(?: international)?(?: version)?(?: v)? ?v?([0-9]{1,2})(?: ([0-9]))?(?![0-9])"


def rules() -> list[dict]:
    """All rules, those with a version behind their plain forms: every name in every form, then notices, sentences and addresses."""
    out = []
    for label, keyword, name in NAMES:
        for before, behind, priority, confidence in FORMS:
            body = rf"(?<![^ ]){before}(?:{name}){behind}"
            out.append({"label": label, "keyword": keyword, "regex": body + r"(?![^ ])", "versioned": False, "priority": priority, "confidence": confidence})
            out.append({"label": label, "keyword": keyword, "regex": body + VERSION + r"(?![^ ])", "versioned": True, "priority": priority + 5, "confidence": min(1.0, confidence + 0.05)})
    for label, keyword, regex in NOTICES + SENTENCES + ADDRESSES:
        out.append({"label": label, "keyword": keyword, "regex": rf"(?<![^ ])(?:{regex})(?![^ ])", "versioned": False, "priority": 50, "confidence": 0.95})
    return [r | {"number": i} for i, r in enumerate(out)]


def _rule_groups() -> Column:
    """A literal array of (keyword, its rules): each keyword is looked for once in a text."""
    groups: dict[str, list[Column]] = {}
    for r in rules():
        one = F.struct(*(F.lit(r[c]).alias(c) for c in ("number", "label", "regex", "versioned", "priority", "confidence")))
        groups.setdefault(r["keyword"], []).append(one)
    return F.array(*(F.struct(F.lit(k).alias("keyword"), F.array(*rs).alias("rules")) for k, rs in groups.items()))


DETECTION = "struct<start:int,stop:int,label:string,number:int,priority:int,confidence:double>"


def _detections(words: Column, r: Column) -> Column:
    """A rule's matches with their places, from what stands between and in them."""
    found = F.regexp_extract_all(words, r["regex"], F.lit(0))
    between = F.split(words, r["regex"], -1)
    steps = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("before"), found.alias("match"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        stop = start + F.length(x["match"])
        version = F.regexp_extract(x["match"], VERSION + "$", 1)
        minor = F.regexp_extract(x["match"], VERSION + "$", 2)
        label = F.when(r["versioned"], F.concat(r["label"], F.lit("-"), version, F.lit("."), F.when(minor == "", F.lit("0")).otherwise(minor))).otherwise(r["label"])
        one = F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), label.alias("label"), r["number"].alias("number"), r["priority"].alias("priority"), r["confidence"].alias("confidence"))
        return F.struct(stop.cast("int").alias("at"), F.concat(acc["all"], F.array(one)).alias("all"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{DETECTION}>").alias("all"))
    return F.aggregate(steps, zero, add, lambda acc: acc["all"])


def _unsuppressed(detected: Column) -> Column:
    """Detections that no other one contains, in one sweep.

    In order of start, then the longest, the highest priority and the lowest number first,
    whatever suppresses a detection stands before it, and what stands before it and ends
    no earlier suppresses it. So a detection is kept if it ends behind all before it.
    """
    ordered = F.array_sort(F.transform(detected, lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("back"), (-d["priority"]).alias("low"), d["number"].alias("number"), d["label"].alias("label"), d["confidence"].alias("confidence"))))
    kept = F.struct(F.lit(-1).alias("stop"), F.array().cast(f"array<{DETECTION}>").alias("all"))

    def add(acc: Column, x: Column) -> Column:
        one = F.struct(x["start"].alias("start"), (-x["back"]).alias("stop"), x["label"].alias("label"), x["number"].alias("number"), (-x["low"]).alias("priority"), x["confidence"].alias("confidence"))
        return F.when(-x["back"] > acc["stop"], F.struct((-x["back"]).alias("stop"), F.concat(acc["all"], F.array(one)).alias("all"))).otherwise(acc)

    return F.aggregate(ordered, kept, add, lambda acc: acc["all"])


def _places(spelled: list[str], label: str) -> Column:
    """Where a phrase's words stand in the array `w`, by number of the first."""
    every = F.when(F.contains("words", F.lit(" ".join(spelled))), F.sequence(F.lit(0), F.size("w") - len(spelled))).otherwise(F.array().cast("array<int>"))
    stands = F.filter(every, lambda i: reduce(and_, (F.get(F.col("w"), i + k) == x for k, x in enumerate(spelled))))
    return F.transform(stands, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def scan(df: DataFrame) -> DataFrame:
    """A row per document: base places and labels, kept detections, all labels and a score."""
    low = F.col("low")
    gate = reduce(or_, (low.contains(x) for x in STEMS)) | reduce(or_, (low.contains(x) for x in SHORT)) & low.rlike(SHORT_GATE)
    reduced = F.trim(F.regexp_replace(F.translate("text", UPPER, LOWER), SEPARATOR, " "))
    d = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    d = d.select("doc_id", F.regexp_count("text", F.lit(RAW_WORD)).cast("long").alias("n_words"), F.when(gate, reduced).alias("words"))
    array = F.split("words", " ")
    places = [_places(phrase.split(" "), label) for phrase, label in BASE.items()]
    d = d.withColumn("w", F.when(F.col("words").isNotNull(), array))
    d = d.withColumn("base", F.when(F.col("words").isNotNull(), F.concat(*places)).otherwise(F.array().cast("array<struct<at:long,label:string>>")))
    padded = F.concat(F.lit(" "), F.col("words"), F.lit(" "))
    d = d.withColumn("padded", padded)
    mine = F.flatten(F.transform(F.filter(_rule_groups(), lambda g: F.contains(F.col("padded"), g["keyword"])), lambda g: g["rules"]))
    d = d.withColumn("detected", F.when(F.col("words").isNotNull(), F.flatten(F.transform(mine, lambda r: _detections(F.col("words"), r)))).otherwise(F.array().cast(f"array<{DETECTION}>")))
    d = d.withColumn("kept", _unsuppressed(F.col("detected")))
    labels = F.transform("base", lambda x: x["label"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return d.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["at"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["at"])).alias("last_word"),
        names(labels).alias("base_labels"),
        names(F.concat(labels, F.transform("kept", lambda x: x["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda x: x["confidence"])), F.lit(0.0)).alias("score"),
        F.transform("kept", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["label"].alias("label"))).alias("detections"),
    )
