"""License scans with ordered signature rules.

Rules are regular expressions over lower-cased text (A-Z only), each with a license, a priority and a confidence.
They are written as families: a license has a name pattern, an identifier and sometimes a address or a sentence of its own text,
and each family says how a name is used ("licensed under ...", "... license", an SPDX tag). To these come some 160 signatures of
the licenses' own texts, notices and addresses, written one by one. Over 500 rules result.

A keyword prefilter comes first: a text without any keyword is not scanned at all, and a rule runs only where its license's own keyword stands in the text.
Detections then compete in order of priority, length and place: one whose interval lies inside that of an accepted
detection is suppressed. What remains gives the labels.

Base phrases are found apart from rules, on the text's words, and are never suppressed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import utf8

#: label: (the license's own keywords, name pattern, SPDX pattern or none)
LICENSES: dict[str, tuple[tuple[str, ...], str, str]] = {
    "mit": (("mit", "expat"), r"(?:mit|expat)(?:/x11)?", r"mit(?:-0)?"),
    "apache": (("apache", "asl"), r"(?:apache(?: software)?(?: license)?(?:,? ?v(?:ersion)? ?\.?[12]\.[01])?|asl ?2\.0)", r"apache-[12]\.[01]"),
    "gpl": (("gpl", "general public"), r"(?:gnu )?(?:gplv?[123]?\+?|general public licen[sc]e)(?:,? v(?:ersion)? ?[123](?:\.0)?)?", r"gpl-[123]\.0(?:-only|-or-later|\+)?"),
    "lgpl": (("lgpl", "lesser general", "library general"), r"(?:gnu )?(?:lgplv?[23]?(?:\.1)?\+?|(?:lesser|library) general public licen[sc]e)", r"lgpl-[23]\.[01](?:-only|-or-later|\+)?"),
    "agpl": (("agpl", "affero"), r"(?:gnu )?(?:agplv?3?\+?|affero general public licen[sc]e)", r"agpl-[13]\.0(?:-only|-or-later|\+)?"),
    "bsd-2-clause": (("bsd",), r"(?:simplified|2[- ]clause|two[- ]clause|freebsd) bsd|bsd[- ](?:2|two)[- ]clause", r"bsd-2-clause"),
    "bsd-3-clause": (("bsd",), r"(?:new|modified|revised|3[- ]clause|three[- ]clause) bsd|bsd[- ](?:3|three)[- ]clause", r"bsd-3-clause"),
    "bsd": (("bsd",), r"(?:original |4[- ]clause )?bsd(?:[- ]style)?", r"bsd-4-clause"),
    "mpl": (("mpl", "mozilla"), r"(?:mozilla public licen[sc]e|mpl)(?:,? ?v?(?:ersion)? ?[12]\.[01])?", r"mpl-[12]\.[01]"),
    "epl": (("epl", "eclipse"), r"(?:eclipse public licen[sc]e|epl)(?:[- ,]*v?(?:ersion)? ?[12]\.0)?", r"epl-[12]\.0"),
    "edl": (("eclipse", "edl"), r"eclipse distribution licen[sc]e", r"edl-1\.0"),
    "cddl": (("cddl", "common development"), r"(?:common development and distribution licen[sc]e|cddl)", r"cddl-1\.[01]"),
    "cpl": (("common public", "cpl"), r"(?:common public licen[sc]e|cpl ?1\.0)", r"cpl-1\.0"),
    "eupl": (("eupl", "european union public"), r"(?:european union public licen[sc]e|eupl)", r"eupl-1\.[012]"),
    "isc": (("isc",), r"isc", r"isc"),
    "zlib": (("zlib",), r"zlib(?:/libpng)?", r"zlib"),
    "libpng": (("libpng",), r"libpng", r"libpng(?:-2\.0)?"),
    "boost": (("boost", "bsl"), r"boost software", r"bsl-1\.0"),
    "unlicense": (("unlicense",), r"(?:the )?unlicense", r"unlicense"),
    "wtfpl": (("wtfpl", "what the"), r"(?:wtfpl|do what the \w+ you want to public licen[sc]e)", r"wtfpl"),
    "artistic": (("artistic",), r"artistic(?: licen[sc]e)?(?: ?[12]\.0)?", r"artistic-[12]\.0(?:-perl)?"),
    "perl": (("perl",), r"same terms as perl(?: itself)?", r"artistic-1\.0-perl or gpl-1\.0"),
    "php": (("php",), r"php(?: licen[sc]e)?(?:,? version 3\.0[01]?)?", r"php-3\.0[01]?"),
    "python": (("python", "psf"), r"(?:python software foundation|psf)", r"(?:psf|python)-2\.0"),
    "ruby": (("ruby",), r"ruby", r"ruby"),
    "openssl": (("openssl",), r"openssl", r"openssl"),
    "ofl": (("ofl", "open font"), r"(?:sil )?open font", r"ofl-1\.[01]"),
    "ms-pl": (("microsoft public", "ms-pl"), r"(?:microsoft public licen[sc]e|ms-pl)", r"ms-pl"),
    "ms-rl": (("microsoft reciprocal", "ms-rl"), r"(?:microsoft reciprocal licen[sc]e|ms-rl)", r"ms-rl"),
    "osl": (("open software", "osl"), r"(?:open software licen[sc]e|osl ?3\.0)", r"osl-[123]\.[01]"),
    "afl": (("academic free", "afl"), r"(?:academic free licen[sc]e|afl ?3\.0)", r"afl-[123]\.[012]"),
    "ncsa": (("ncsa", "illinois"), r"(?:university of illinois/ncsa|ncsa)(?: open source)?", r"ncsa"),
    "postgresql": (("postgresql",), r"postgresql", r"postgresql"),
    "w3c": (("w3c",), r"w3c(?: software notice and)?", r"w3c"),
    "x11": (("x11",), r"x11", r"x11"),
    "qpl": (("qpl", "q public"), r"q public", r"qpl-1\.0"),
    "sspl": (("sspl", "server side public"), r"(?:server side public licen[sc]e|sspl)", r"sspl-1\.0"),
    "busl": (("business source", "busl"), r"business source", r"busl-1\.1"),
    "elastic": (("elastic",), r"elastic", r"elastic-2\.0"),
    "odbl": (("odbl", "open database"), r"(?:open database licen[sc]e|odbl)", r"odbl-1\.0"),
    "odc-by": (("odc-by", "open data commons"), r"(?:open data commons attribution|odc-by)", r"odc-by-1\.0"),
    "pddl": (("pddl", "public domain dedication"), r"(?:public domain dedication and licen[sc]e|pddl)", r"pddl-1\.0"),
    "gfdl": (("gfdl", "free documentation"), r"(?:gnu )?(?:free documentation licen[sc]e|gfdl)", r"gfdl-1\.[123](?:-only|-or-later)?"),
    "cc0": (("cc0", "cc zero"), r"(?:cc0(?: ?1\.0)?|cc zero)", r"cc0-1\.0"),
    "cc-by-nc-sa": (("cc", "creative commons"), r"(?:cc|creative commons)[- ](?:by-nc-sa|attribution[- ]noncommercial[- ]share ?alike)(?: [1-4]\.\d)?", r"cc-by-nc-sa-[1-4]\.\d"),
    "cc-by-nc-nd": (("cc", "creative commons"), r"(?:cc|creative commons)[- ](?:by-nc-nd|attribution[- ]noncommercial[- ]noderivs?)(?: [1-4]\.\d)?", r"cc-by-nc-nd-[1-4]\.\d"),
    "cc-by-nc": (("cc", "creative commons"), r"(?:cc|creative commons)[- ](?:by-nc|attribution[- ]noncommercial)(?: [1-4]\.\d)?", r"cc-by-nc-[1-4]\.\d"),
    "cc-by-sa": (("cc", "creative commons"), r"(?:cc|creative commons)[- ](?:by-sa|attribution[- ]share ?alike)(?: [1-4]\.\d)?", r"cc-by-sa-[1-4]\.\d"),
    "cc-by-nd": (("cc", "creative commons"), r"(?:cc|creative commons)[- ](?:by-nd|attribution[- ]noderivs?)(?: [1-4]\.\d)?", r"cc-by-nd-[1-4]\.\d"),
    "cc-by": (("cc", "creative commons"), r"(?:cc|creative commons)[- ](?:by|attribution)(?: [1-4]\.\d)?", r"cc-by-[1-4]\.\d"),
}
#: (rule family, priority, confidence, pattern); @ is the name, # the identifier
FAMILIES: tuple[tuple[str, int, float, str], ...] = (
    ("tag", 100, 1.0, r"spdx-license-identifier:\s*(?:#)(?![\w.-])"),
    ("grant", 90, 0.95, r"licen[sc]ed\s+(?:to you\s+)?under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?(?:@)(?![\w-])(?:\s+licen[sc]e)?"),
    ("release", 85, 0.95, r"(?:released|distributed|available|published|provided|shared|redistributed)\s+under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?(?:@)(?![\w-])(?:\s+licen[sc]e)?"),
    ("field", 80, 0.9, r"\"?licen[sc]e\"?\s*[:=]\s*[\"']?(?:#|@)(?![\w.-])"),
    ("named", 70, 0.8, r"(?<![\w-])(?:@)\s+licen[sc]e(?!\w)"),
    ("terms", 65, 0.8, r"(?:terms|conditions|provisions)\s+of\s+(?:the\s+)?(?:@)(?![\w-])"),
    ("under", 60, 0.6, r"(?<!\w)under\s+(?:the\s+)?(?:@)(?![\w-])"),
)
#: (label, rule, priority, confidence, keyword, pattern): sentences and addresses of licenses' own
SENTENCES: tuple[tuple[str, str, int, float, str, str], ...] = (
    ("mit", "mit-text", 95, 1.0, "permission is hereby granted", r"permission is hereby granted,\s+free of charge,\s+to any person obtaining a copy"),
    ("isc", "isc-text", 95, 1.0, "permission to use", r"permission to use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute this software for any purpose"),
    ("bsd", "bsd-text", 88, 0.9, "redistribution and use", r"redistribution and use in source and binary forms,\s+with or without\s+modification,\s+are permitted"),
    ("bsd-3-clause", "bsd-3-text", 92, 0.9, "endorse or promote", r"neither the names? of .{0,80}?\bmay be used to\s+endorse or promote products"),
    ("gpl", "gpl-text", 90, 0.95, "free software foundation", r"it under the terms of the gnu general public licen[sc]e\s+as\s+published by\s+the free software foundation"),
    ("unlicense", "unlicense-text", 90, 0.95, "public domain", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public-domain", 50, 0.6, "domain", r"(?:released|placed|dedicated)\s+(?:in)?to\s+the\s+public\s+domain"),
    ("proprietary", "all-rights-reserved", 40, 0.5, "all rights reserved", r"all rights reserved"),
    ("apache", "apache-url", 92, 1.0, "apache.org/licenses", r"apache\.org/licenses/license-[12]\.[01]"),
    ("gpl", "gnu-url", 75, 0.7, "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("lgpl", "gnu-lesser-url", 75, 0.7, "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("agpl", "gnu-affero-url", 75, 0.7, "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?agpl"),
    ("mit", "mit-url", 75, 0.8, "opensource.org", r"opensource\.org/licenses/mit(?![\w-])"),
    ("mpl", "mpl-url", 92, 0.9, "mozilla.org/mpl", r"mozilla\.org/mpl/(?:2\.0|1\.1)?"),
    ("cc0", "cc0-url", 92, 1.0, "creativecommons.org", r"creativecommons\.org/publicdomain/zero/"),
    ("cc-by", "cc-by-url", 92, 1.0, "creativecommons.org", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", "cc-by-sa-url", 92, 1.0, "creativecommons.org", r"creativecommons\.org/licenses/by-sa/"),
    ("cc-by-nc", "cc-by-nc-url", 92, 1.0, "creativecommons.org", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", "cc-by-nd-url", 92, 1.0, "creativecommons.org", r"creativecommons\.org/licenses/by-nd/"),
    ("cc-by-nc-sa", "cc-by-nc-sa-url", 92, 1.0, "creativecommons.org", r"creativecommons\.org/licenses/by-nc-sa/"),
    ("cc-by-nc-nd", "cc-by-nc-nd-url", 92, 1.0, "creativecommons.org", r"creativecommons\.org/licenses/by-nc-nd/"),
)
#: (label, keyword, pattern): what the licenses' own texts and notices say, written out one by one; a blank stands for any white space
TEXTS: tuple[tuple[str, str, str], ...] = (
    ("mit", "noninfringement", r"merchantability, fitness for a particular purpose and noninfringement\. in no event shall the authors"),
    ("mit", "sublicense", r"to use, copy, modify, merge, publish, distribute, sublicense,? and/or sell copies of the software"),
    ("mit", "substantial", r"permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "expat", r"expat licen[sc]e \(mit\)"),
    ("x11", "consortium", r"except as contained in this notice, the name of the (?:x|open) consortium"),
    ("x11", "advertising", r"shall not be used in advertising or otherwise to promote the sale, use or other dealings in this software"),
    ("isc", "hereby", r"distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", r"software is provided \"as is\" and (?:the author|isc) disclaims all warranties"),
    ("bsd", "retain", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "reproduce", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "regents", r"the regents of the university of california"),
    ("bsd", "acknowledgement", r"all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-2-clause", "freebsd", r"official policies, either expressed or implied, of the freebsd project"),
    ("bsd-3-clause", "contributors", r"names of its contributors may be used to endorse"),
    ("bsd-3-clause", "written", r"from this software without specific prior written permission"),
    ("apache", "contributor", r"to the apache software foundation \(asf\) under one or more contributor license agreements"),
    ("apache", "asf", r"the asf licenses this file to you"),
    ("apache", "except", r"you may not use this file except in compliance with the license"),
    ("apache", "limitations", r"for the specific language governing permissions and limitations under the license"),
    ("apache", "express", r"\"as is\" basis, without warranties or conditions of any kind, either express or implied"),
    ("apache", "grant", r"subject to the terms and conditions of this license, each contributor hereby grants"),
    ("apache", "developed", r"this product includes software developed by the apache (?:software foundation|group)"),
    ("apache", "derivative", r"\"derivative works\" shall mean any work, whether in source or object form, that is based on \(or derived from\) the work"),
    ("gpl", "redistribute", r"is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public"),
    ("gpl", "later", r"either version [23] of the license, or \(at your option\) any later version"),
    ("gpl", "without", r"without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public"),
    ("gpl", "received", r"you should have received a copy of the gnu general public licen[sc]e along with this"),
    ("gpl", "copyleft", r"the gnu general public licen[sc]e is a free, copyleft licen[sc]e"),
    ("gpl", "freedom", r"licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", "foundation", r"free software foundation, inc\., (?:51 franklin|59 temple)"),
    ("gpl", "gplv2", r"dual licensed under (?:the )?gplv2"),
    ("gpl", "classpath", r"gpl(?:v2|-2\.0)? with (?:the )?classpath exception"),
    ("gpl", "module_license", r"module_license\s*\(\s*\"(?:dual [a-z]+/)?gpl"),
    ("gpl", "exception", r"as a special exception, the copyright holders .{0,60}give (?:you )?permission to link"),
    ("lgpl", "general", r"under the terms of the gnu (?:lesser|library) general public licen[sc]e as published by"),
    ("lgpl", "received", r"received a copy of the gnu (?:lesser|library) general public"),
    ("lgpl", "weak", r"weak copyleft \(lgpl\)"),
    ("lgpl", "library", r"a \"work that uses the library\""),
    ("agpl", "affero", r"under the terms of the gnu affero general public licen[sc]e as published by"),
    ("agpl", "remotely", r"interacting with it remotely through a computer network"),
    ("agpl", "received", r"received a copy of the gnu affero general public"),
    ("gfdl", "invariant", r"with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts"),
    ("gfdl", "granted", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation"),
    ("mpl", "mpl", r"if a copy of the mpl was not distributed with this file, you can obtain one"),
    ("mpl", "subject", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl", "mozilla", r"the contents of this file are subject to the mozilla public licen[sc]e"),
    ("mpl", "incompatible", r"incompatible with secondary licenses\", as defined by the mozilla public"),
    ("epl", "eclipse", r"made available under the terms of the eclipse public licen[sc]e"),
    ("epl", "accompanies", r"this program and the accompanying materials .{0,80}which accompanies this distribution"),
    ("epl", "epl-v", r"eclipse\.org/legal/epl-v"),
    ("edl", "edl-v", r"eclipse\.org/org/documents/edl-v"),
    ("cddl", "cddl", r"licensed under the cddl"),
    ("cddl", "opensolaris", r"opensolaris\.org/os/licensing|usr/src/opensolaris\.license"),
    ("cpl", "common", r"program is provided under the terms of this common public licen[sc]e"),
    ("eupl", "eupl", r"licensed under the eupl"),
    ("eupl", "approved", r"eupl, version 1\.[012] or .{0,20}as soon they will be approved by the european commission"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "plainly", r"altered source versions must be plainly marked as such"),
    ("zlib", "liable", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("libpng", "png", r"the png reference library is supplied \"as is\""),
    ("boost", "boost", r"distributed under the boost software licen[sc]e"),
    ("boost", "license_1_0", r"boost\.org/license_1_0\.txt"),
    ("boost", "machine-executable", r"solely in the form of machine-executable object code generated by a source language processor"),
    ("unlicense", "unlicense.org", r"unlicense\.org"),
    ("unlicense", "anyone", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("unlicense", "jurisdictions", r"in jurisdictions that recognize copyright laws, the author or authors of this software dedicate"),
    ("wtfpl", "just", r"you just do what the \w+ you want to"),
    ("wtfpl", "wtfpl.net", r"wtfpl\.net"),
    ("artistic", "artistic", r"under the terms of the artistic licen[sc]e"),
    ("artistic", "standard", r"\"standard version\" refers to (?:such a|the) package"),
    ("perl", "perl", r"free software; you can redistribute it and/or modify it under the same terms as perl"),
    ("php", "php", r"this source file is subject to version 3\.0[01]? of the php licen[sc]e"),
    ("php", "php.net", r"php\.net/license"),
    ("python", "psf", r"psf is making python available to licensee on an \"as is\" basis"),
    ("python", "python", r"this license agreement is between the python software foundation"),
    ("python", "corporation", r"corporation for national research initiatives"),
    ("ruby", "ruby", r"ruby is copyrighted free software by yukihiro matsumoto"),
    ("openssl", "openssl", r"software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "eric", r"cryptographic software written by eric young"),
    ("ofl", "font", r"this font software is licensed under the sil open font licen[sc]e"),
    ("ofl", "reserved", r"with reserved font names?"),
    ("ofl", "sil.org", r"scripts\.sil\.org/ofl"),
    ("ms-pl", "microsoft", r"subject to the microsoft public licen[sc]e"),
    ("ms-pl", "ms-pl", r"this license governs use of the accompanying software.{0,200}ms-pl"),
    ("ms-rl", "reciprocal", r"\(a\) reciprocal grants"),
    ("osl", "open", r"licensed under the open software licen[sc]e"),
    ("afl", "academic", r"licensed under the academic free licen[sc]e"),
    ("ncsa", "university", r"university of illinois/ncsa open source licen[sc]e"),
    ("ncsa", "llvm", r"the llvm compiler infrastructure is under the (?:apache|university of illinois)"),
    ("postgresql", "paragraphs", r"this paragraph and the following two paragraphs appear in all copies"),
    ("postgresql", "postgresql", r"postgresql database management system"),
    ("w3c", "w3c", r"w3c(?:\(r\)|®)? software (?:notice and|and document) licen[sc]e"),
    ("w3c", "world", r"world wide web consortium, \(?massachusetts institute of technology"),
    ("qpl", "trolltech", r"this file may be distributed under the terms of the q public licen[sc]e as defined by trolltech"),
    ("sspl", "server", r"offering the program as a service.{0,80}server side public|server side public licen[sc]e, version 1"),
    ("sspl", "mongodb", r"as published by mongodb, inc\."),
    ("busl", "change", r"change date: .{0,60}change license:"),
    ("busl", "additional", r"additional use grant:"),
    ("busl", "business", r"the business source license \(.{0,30}\) is not an open source license"),
    ("elastic", "elastic", r"elastic licen[sc]e 2\.0"),
    ("odbl", "opendatacommons", r"opendatacommons\.org/licenses/odbl"),
    ("odbl", "openstreetmap", r"© openstreetmap contributors"),
    ("odc-by", "opendatacommons", r"opendatacommons\.org/licenses/by/"),
    ("pddl", "opendatacommons", r"opendatacommons\.org/licenses/pddl"),
    ("cc0", "waived", r"has waived all copyright and related or neighboring rights"),
    ("cc0", "affirmer", r"affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives"),
    ("cc0", "cc0", r"cc0 1\.0 universal"),
    ("cc-by", "attribution", r"creative commons attribution [1-4]\.\d (?:international|unported|generic)"),
    ("cc-by-sa", "sharealike", r"creative commons attribution-sharealike [1-4]\.\d (?:international|unported|generic)"),
    ("cc-by-nc", "noncommercial", r"creative commons attribution-noncommercial [1-4]\.\d (?:international|unported|generic)"),
    ("cc-by-nd", "noderiv", r"creative commons attribution-noderiv(?:s|atives) [1-4]\.\d (?:international|unported|generic)"),
    ("cc-by-nc-sa", "sharealike", r"creative commons attribution-noncommercial-sharealike [1-4]\.\d"),
    ("cc-by-nc-nd", "noderiv", r"creative commons attribution-noncommercial-noderiv(?:s|atives) [1-4]\.\d"),
    ("cc-by", "rights", r"\(cc\) some rights reserved"),
    ("boost", "organization", r"free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("curl", "stenberg", r"daniel stenberg, .{0,40}all rights reserved\. permission to use"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", "freetype", r"portions of this software are copyright .{0,20}the freetype project"),
    ("icu", "unicode", r"unicode data files or software|unicode, inc\. license agreement"),
    ("bzip2", "bzip2", r"this program, \"bzip2\""),
    ("vim", "vim", r"vim is charityware"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    ("json", "evil", r"the software shall be used for good, not evil"),
    ("hpnd", "supporting", r"both that copyright notice and this permission notice appear in supporting documentation"),
    ("ecl", "educational", r"educational community licen[sc]e,? version 2\.0"),
    ("upl", "universal", r"universal permissive licen[sc]e"),
    ("mulan", "mulan", r"mulan (?:psl|permissive software licen[sc]e)"),
    ("cecill", "cecill", r"governed by the cecill(?:-[bc])? licen[sc]e"),
    ("llama", "community", r"llama (?:[23](?:\.\d)? )?community license agreement"),
    ("openrail", "rail", r"(?:bigscience|creativeml) openrail-?m|open rail-m"),
    ("commons-clause", "commons", r"\"commons clause\" license condition"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict) licen[sc]e"),
    ("public-domain", "copyright", r"copyright expired|no known copyright restrictions"),
    ("public-domain", "united", r"work of the united states government.{0,80}public domain"),
    ("public-domain", "disclaims", r"the author disclaims copyright to this source code"),
    ("proprietary", "confidential", r"confidential and proprietary"),
    ("proprietary", "strictly", r"unauthorized (?:copying|use|reproduction|distribution)[^.]{0,80}strictly prohibited"),
    ("proprietary", "written", r"without the (?:express |prior )*written (?:consent|permission) of the (?:copyright )?(?:owner|holder|publisher)"),
    ("proprietary", "reproduced", r"no part of this (?:publication|book|work) may be reproduced"),
    ("proprietary", "trade", r"contains trade secrets"),
    ("proprietary", "user", r"end user license agreement"),
)
#: Some word that every family's text holds; without any the rules of families can't match. Bare words, as any white space may follow.
GENERAL = ("licen", "under", "terms", "conditions", "provisions")
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    confidence: float
    keywords: tuple[str, ...]
    pattern: str


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, in order of priority, then of name."""
    out = [Rule(f"{label}/{family}", label, priority, confidence, keys, pattern.replace("@", name).replace("#", spdx)) for label, (keys, name, spdx) in LICENSES.items() for family, priority, confidence, pattern in FAMILIES]
    out += [Rule(name, label, priority, confidence, (key,), pattern) for label, name, priority, confidence, key, pattern in SENTENCES]
    out += [Rule(f"{label}-{key}-{i}", label, 89, 0.9, (key,), pattern.replace(" ", r"\s+")) for i, (label, key, pattern) in enumerate(TEXTS)]
    return tuple(sorted(out, key=lambda r: (-r.priority, r.name)))


#: Rules whose texts all hold a word of GENERAL
FAMILY_RULES = frozenset(f"{label}/{family}" for label in LICENSES for family, *_ in FAMILIES)


class Scanner:
    """Compiled rules; made once in each worker."""

    def __init__(self, chosen: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern, re.S), tuple(k.encode() for k in r.keywords)) for r in chosen]
        self.keys = sorted({k for _, _, keys in self.rules for k in keys})
        own = {k for r, _, keys in self.rules if r.name not in FAMILY_RULES for k in keys}
        self.gate = tuple(own | {x.encode() for x in GENERAL})

    def detect(self, lowered: bytes) -> list[tuple[Rule, int, int, bool]]:
        """(rule, start, end, kept) in characters, in the order in which they compete."""
        if not any(g in lowered for g in self.gate):
            return []
        here = {k for k in self.keys if k in lowered}
        active = [(r, p) for r, p, keys in self.rules if any(k in here for k in keys)]
        if not active:
            return []
        text = lowered.decode("utf-8", "replace")
        found = [(r, m.start(), m.end()) for r, p in active for m in p.finditer(text) if m.end() > m.start()]
        found.sort(key=lambda x: (-x[0].priority, x[1] - x[2], x[1], x[0].name))
        out, kept = [], Intervals()
        for r, start, end in found:
            stays = not kept.hold(start, end)
            if stays:
                kept.add(start, end)
            out.append((r, start, end, stays))
        return out


class Intervals:
    """Intervals none of which lies inside another; asks whether one of them holds a given one."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def hold(self, start: int, end: int) -> bool:
        # ends rise with starts, so the last interval that starts in time reaches furthest
        from bisect import bisect_right

        at = bisect_right(self.starts, start) - 1
        return at >= 0 and self.ends[at] >= end

    def add(self, start: int, end: int) -> None:
        from bisect import bisect_left

        at = bisect_left(self.starts, start)
        stop = at
        while stop < len(self.ends) and self.ends[stop] <= end:
            stop += 1
        self.starts[at:stop] = [start]
        self.ends[at:stop] = [end]


def base_places(data: bytes, phrases: tuple[tuple[str, str], ...] = BASE) -> tuple[int, list[tuple[int, str]]]:
    """The number of words, and (first word, label) for each place of a phrase."""
    plain = data.translate(_WORDS)
    words = plain.split()
    if not any(p.split()[-1].encode() in plain for p, _ in phrases):
        return len(words), []
    joined, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases:
        needle, at, before, counted = b" " + phrase.encode() + b" ", 0, 0, 0
        while (at := joined.find(needle, at)) >= 0:
            before += joined.count(b" ", counted, at)
            counted = at
            out.append((before, label))
            at += 1
    return len(words), sorted(out)


KIND = "struct<n_words:bigint,base:array<struct<word:bigint,label:string>>,found:array<struct<rule:string,label:string,priority:int,confidence:double,start:bigint,stop:bigint,kept:boolean>>>"


def scan(docs: DataFrame, chosen: tuple[Rule, ...] | None = None, text: str = "text", to: str = "license") -> DataFrame:
    """``docs`` with the struct ``to``: n_words, base (places of base phrases), found (every detection, with whether it was kept).

    Null counts as the empty text. Only the text is read, whole whatever its length. Detections of one priority and length compete by place, then
    by name. Repeated rows give the same. A column named ``to`` is replaced, all others pass through. An empty table stays empty.
    """
    chosen = rules() if chosen is None else chosen

    @F.arrow_udf(KIND)
    def udf(texts: pa.Array) -> pa.Array:
        scanner = Scanner(chosen)
        out = []
        for data in utf8(texts):
            data = data or b""
            n, base = base_places(data)
            found = scanner.detect(data.translate(_ASCII))
            out.append({"n_words": n, "base": [{"word": w, "label": x} for w, x in base], "found": [{"rule": r.name, "label": r.label, "priority": r.priority, "confidence": r.confidence, "start": a, "stop": b, "kept": k} for r, a, b, k in found]})
        found = pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("priority", pa.int32()), ("confidence", pa.float64()), ("start", pa.int64()), ("stop", pa.int64()), ("kept", pa.bool_())]))
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("base", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))), ("found", found)]))

    return docs.withColumn(to, udf(F.col(text)))
