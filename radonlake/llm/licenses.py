"""License scans (operator 3): ordered signature rules behind a keyword prefilter, without Python on the data's path.

A text becomes its words joined by single spaces, on which rules are regular expressions of words. One test for all keywords
leaves out most texts; of the rest, each rule runs whose own keyword the text has. Detections are intervals of words; one is
suppressed where another of the same or a higher priority contains it.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """pattern: a regular expression over words with single spaces between; keyword: words that each match has, from a word's start; a family's pattern has a rule for each of its keywords, and each match has one of those. Priority 0 is the highest."""

    label: str
    keyword: str
    pattern: str
    priority: int = 1
    weight: float = 0.8


BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

# What licenses and notices say, by label: (keyword, pattern, priority, weight).
_NAMED = {
    "mit": [
        ("mit license", r"mit license", 2, 0.7), ("mit license mit", r"the mit license mit", 1, 0.9), ("mit license", r"licensed under the mit license", 1, 0.95), ("licensed under mit", r"licensed under mit", 2, 0.8), ("mit license", r"released under the mit license", 1, 0.95),
        ("permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 0, 1.0), ("expat", r"expat license", 2, 0.8), ("without restriction", r"to deal in the software without restriction", 1, 0.9), ("spdx license identifier mit", r"spdx license identifier mit", 0, 1.0),
    ],
    "mit-0": [("mit no attribution", r"mit no attribution(?: license)?", 0, 0.95), ("spdx license identifier mit 0", r"spdx license identifier mit 0", 0, 1.0)],
    "x11": [("x11 license", r"x11 license", 2, 0.8), ("x consortium", r"copyright c 19\d\d x consortium", 1, 0.8)],
    "isc": [("isc license", r"isc license", 2, 0.8), ("permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0, 1.0), ("spdx license identifier isc", r"spdx license identifier isc", 0, 1.0)],
    "0bsd": [("zero clause bsd", r"zero clause bsd(?: license)?", 0, 0.95), ("0bsd", r"(?:spdx license identifier )?0bsd", 0, 0.95)],
    "apache": [("apache license", r"apache license", 3, 0.7), ("apache software license", r"apache software license", 2, 0.8), ("apache", r"licensed under the apache license version \d(?: \d)?", 0, 1.0), ("apache", r"you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org", 0, 1.0)],
    "gpl": [("general public license", r"general public license", 3, 0.7), ("free software foundation", r"terms of the gnu general public license as published by the free software foundation", 1, 0.95), ("gpl", r"gnu gpl", 2, 0.8), ("gpl", r"licensed under the gpl", 2, 0.8), ("copyleft", r"copyleft license", 3, 0.4)],
    "lgpl": [("lesser general public license", r"(?:gnu )?lesser general public license", 1, 0.9), ("library general public license", r"(?:gnu )?library general public license", 1, 0.9), ("lgpl", r"(?:gnu )?lgpl", 2, 0.8)],
    "agpl": [("affero general public license", r"(?:gnu )?affero general public license", 1, 0.9), ("agpl", r"(?:gnu )?agpl", 2, 0.8)],
    "gfdl": [("free documentation license", r"(?:gnu )?free documentation license", 1, 0.9), ("gfdl", r"(?:gnu )?gfdl", 2, 0.8)],
    "bsd": [("bsd license", r"bsd license", 3, 0.7), ("bsd style license", r"bsd style license", 2, 0.7), ("redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 1, 0.95), ("bsd", r"licensed under the bsd license", 1, 0.9)],
    "bsd-2-clause": [("bsd", r"(?:the )?(?:simplified bsd license|bsd 2 clause(?: license)?|2 clause bsd(?: license)?)", 0, 0.95), ("freebsd license", r"(?:the )?freebsd license", 0, 0.95)],
    "bsd-3-clause": [("bsd", r"(?:the )?(?:new bsd license|modified bsd license|bsd 3 clause(?: license)?|3 clause bsd(?: license)?)", 0, 0.95), ("endorse or promote", r"may be used to endorse or promote products derived from this software without specific prior written permission", 0, 0.95)],
    "bsd-4-clause": [("bsd", r"(?:the )?(?:original bsd license|bsd 4 clause(?: license)?|4 clause bsd(?: license)?)", 0, 0.95), ("advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledgement", 0, 1.0)],
    "mpl": [("mozilla public license", r"mozilla public license", 2, 0.85), ("source code form is subject", r"this source code form is subject to the terms of the mozilla public license v 2 0", 0, 1.0)],
    "epl": [("eclipse public license", r"eclipse public license", 2, 0.85), ("eclipse distribution license", r"eclipse distribution license", 2, 0.85)],
    "cpl": [("common public license", r"common public license", 2, 0.85)],
    "ipl": [("ibm public license", r"ibm public license", 2, 0.85)],
    "cddl": [("common development and distribution license", r"common development and distribution license", 1, 0.9), ("cddl", r"cddl", 2, 0.8)],
    "eupl": [("european union public", r"european union public licen[cs]e", 1, 0.9), ("eupl", r"eupl", 2, 0.8)],
    "osl": [("open software license", r"open software license", 2, 0.85)],
    "afl": [("academic free license", r"academic free license", 1, 0.9)],
    "artistic": [("artistic license", r"(?:perl )?artistic license", 2, 0.85), ("artistic licence", r"artistic licence", 2, 0.85)],
    "perl": [("same terms as perl", r"under the same terms as perl itself", 1, 0.9)],
    "python": [("python software foundation license", r"python software foundation license", 1, 0.9), ("psf license", r"psf license(?: agreement)?", 1, 0.9)],
    "php": [("php license", r"php license", 2, 0.85)],
    "ruby": [("ruby license", r"ruby license", 2, 0.8), ("same terms as ruby", r"under the same terms as ruby", 1, 0.9)],
    "zlib": [("zlib license", r"zlib license", 1, 0.85), ("zlib libpng license", r"zlib libpng license", 1, 0.85), ("as is without any express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0, 0.95)],
    "libpng": [("libpng license", r"libpng license", 1, 0.85)],
    "bsl": [("boost software license", r"boost software license", 1, 0.95)],
    "busl": [("business source license", r"business source license", 1, 0.95)],
    "sspl": [("server side public license", r"server side public license", 1, 0.95), ("sspl", r"sspl", 2, 0.8)],
    "elastic": [("elastic license", r"elastic license", 1, 0.9)],
    "unlicense": [("unlicense", r"(?:the )?unlicense", 1, 0.9), ("released into the public domain", r"free and unencumbered software released into the public domain", 0, 1.0)],
    "wtfpl": [("wtfpl", r"wtfpl", 1, 0.9), ("what the fuck you want", r"do what the fuck you want to public license", 0, 1.0)],
    "beerware": [("beer ware license", r"(?:the )?beer ware license", 1, 0.95)],
    "public-domain": [("public domain", r"(?:placed|dedicated|released|put) (?:in|to|into) the public domain", 1, 0.85), ("public domain", r"public domain", 3, 0.4), ("no copyright", r"no copyright is claimed", 2, 0.6)],
    "cc0": [("cc0", r"cc0(?: 1 0(?: universal)?)?", 1, 0.9), ("public domain dedication", r"public domain dedication", 2, 0.8)],
    "cc": [("creative commons", r"creative commons", 3, 0.5), ("creative commons", r"creative commons (?:attribution )?license", 2, 0.7)],
    "odbl": [("open database license", r"open database license", 1, 0.9), ("odbl", r"odbl", 2, 0.8)],
    "odc-by": [("open data commons attribution", r"open data commons attribution license", 1, 0.9)],
    "pddl": [("public domain dedication and license", r"public domain dedication and license", 0, 0.95)],
    "ofl": [("sil open font license", r"sil open font license", 1, 0.95), ("open font license", r"open font license", 2, 0.85)],
    "ncsa": [("illinois ncsa", r"university of illinois ncsa open source license", 1, 0.95), ("ncsa open source license", r"ncsa open source license", 2, 0.85)],
    "postgresql": [("postgresql license", r"postgresql license", 1, 0.9)],
    "openssl": [("openssl license", r"openssl license", 1, 0.9), ("openssl toolkit", r"this product includes software developed by the openssl project for use in the openssl toolkit", 0, 1.0)],
    "curl": [("curl license", r"curl license", 1, 0.85)],
    "vim": [("vim license", r"vim license", 1, 0.85)],
    "tcl": [("tcl tk license", r"tcl tk license", 1, 0.85)],
    "icu": [("icu license", r"icu license", 1, 0.85)],
    "unicode": [("unicode license", r"unicode license(?: agreement)?", 1, 0.85)],
    "w3c": [("w3c software", r"w3c software (?:notice and license|and document license)", 1, 0.95)],
    "zpl": [("zope public license", r"zope public license", 1, 0.95)],
    "qpl": [("q public license", r"q public license", 1, 0.9)],
    "sleepycat": [("sleepycat license", r"sleepycat license", 1, 0.9)],
    "ms-pl": [("microsoft public license", r"microsoft public license", 1, 0.95), ("ms pl", r"ms pl", 2, 0.7)],
    "ms-rl": [("microsoft reciprocal license", r"microsoft reciprocal license", 1, 0.95)],
    "upl": [("universal permissive license", r"universal permissive license", 1, 0.95)],
    "mulan": [("mulan psl", r"mulan psl v ?\d", 1, 0.95), ("mulan permissive software license", r"mulan permissive software license", 1, 0.95)],
    "cecill": [("cecill", r"cecill(?: [abc])?(?: license)?", 1, 0.9)],
    "bluooak": [("blue oak model license", r"blue oak model license", 1, 0.95)],
    "json": [("good not evil", r"the software shall be used for good not evil", 0, 1.0)],
    "notice": [("all rights reserved", r"all rights reserved", 3, 0.3), ("copyright", r"copyright(?: c)? (?:19|20)\d\d", 3, 0.3), ("without warranty", r"without warranty of any kind", 3, 0.3), ("as is", r"(?:software|work) is provided as is", 3, 0.3), ("without any warranty", r"without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", 2, 0.5), ("proprietary", r"proprietary and confidential", 3, 0.4), ("license", r"see (?:the )?license(?: file)? for (?:details|more information)", 3, 0.4)],
}

# Licenses known by one name or notice each, and further wordings of those above: (label, keyword, pattern, priority, weight).
_MORE = (
    ("mit", "mit licence", r"(?:the )?mit licence", 2, 0.7),
    ("mit", "distributed under the mit", r"(?:is )?distributed under the mit (?:license|licence|terms)", 1, 0.95),
    ("mit", "above copyright notice and this permission notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0, 1.0),
    ("mit", "dual licensed under mit", r"dual licensed under mit and apache", 1, 0.9),
    ("mit", "licensed under the terms of the mit license", r"licensed under the terms of the mit license", 1, 0.95),
    ("mit", "license mit", r"license mit", 3, 0.6),
    ("mit-advertising", "mit license with advertising", r"mit license with advertising(?: clause)?", 0, 0.95),
    ("mit-cmu", "cmu license", r"(?:the )?cmu license", 2, 0.8),
    ("mit-cmu", "carnegie mellon university", r"the name of carnegie mellon university may not be used in advertising or publicity", 0, 0.95),
    ("mit-feh", "mit feh license", r"mit feh license", 0, 0.9),
    ("mit-modern-variant", "modern variant of the mit license", r"modern variant of the mit license", 0, 0.9),
    ("hpnd", "historical permission notice and disclaimer", r"historical permission notice and disclaimer", 1, 0.95),
    ("hpnd", "supporting documentation", r"that both that copyright notice and this permission notice appear in supporting documentation", 0, 0.95),
    ("ntp", "ntp license", r"ntp license(?: attribution)?", 1, 0.85),
    ("isc", "isc licence", r"(?:the )?isc licence", 2, 0.8),
    ("isc", "author disclaims all warranties", r"the software is provided as is and the author disclaims all warranties", 0, 0.9),
    ("0bsd", "free public license 1 0 0", r"free public license 1 0 0", 0, 0.95),
    ("apache-1.0", "apache group for use", r"this product includes software developed by the apache group for use in the apache http server project", 0, 1.0),
    ("apache-1.1", "apache software foundation http", r"this product includes software developed by the apache software foundation http www apache org", 0, 1.0),
    ("apache-2.0", "asf under one or more", r"licensed to the asf under one or more contributor license agreements", 0, 0.95),
    ("apache-2.0", "apache license version 2 0 january 2004", r"apache license version 2 0 january 2004", 0, 1.0),
    ("apache-2.0", "unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0, 0.95),
    ("apache-2.0", "spdx license identifier apache 2 0", r"spdx license identifier apache 2 0", 0, 1.0),
    ("apache-2.0", "license apache 2 0", r"license apache 2 0", 1, 0.9),
    ("apache-2.0-with-llvm-exception", "apache 2 0 with llvm", r"apache 2 0 with llvm exception", 0, 1.0),
    ("apache", "apache licence", r"apache licence", 2, 0.7),
    ("gpl", "gnu general public licence", r"gnu general public licence", 2, 0.8),
    ("gpl", "free software you can redistribute it", r"(?:this program|it) is free software you can redistribute it and or modify it", 1, 0.8),
    ("gpl", "received a copy of the gnu general public license", r"you should have received a copy of the gnu general public license along with this program", 0, 0.95),
    ("gpl", "released under the gpl", r"released under the gpl", 1, 0.9),
    ("gpl", "covered by the gnu gpl", r"covered by the gnu gpl", 1, 0.9),
    ("gpl-2.0", "spdx license identifier gpl 2 0", r"spdx license identifier gpl 2 0", 0, 1.0),
    ("gpl-2.0-only", "spdx license identifier gpl 2 0 only", r"spdx license identifier gpl 2 0 only", 0, 1.0),
    ("gpl-2.0-or-later", "spdx license identifier gpl 2 0 or later", r"spdx license identifier gpl 2 0 or later", 0, 1.0),
    ("gpl-3.0", "spdx license identifier gpl 3 0", r"spdx license identifier gpl 3 0", 0, 1.0),
    ("gpl-3.0-or-later", "spdx license identifier gpl 3 0 or later", r"spdx license identifier gpl 3 0 or later", 0, 1.0),
    ("gpl-with-classpath-exception", "classpath exception", r"(?:with (?:the )?)?classpath exception(?: 2 0)?", 1, 0.8),
    ("gpl-with-classpath-exception", "linking this library statically", r"linking this library statically or dynamically with other modules", 0, 0.95),
    ("gpl-with-gcc-exception", "gcc runtime library exception", r"gcc runtime library exception", 0, 0.95),
    ("gpl-with-autoconf-exception", "autoconf configure script exception", r"autoconf configure script exception", 0, 0.95),
    ("gpl-with-bison-exception", "bison parser", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton", 0, 0.95),
    ("gpl-with-font-exception", "gpl font exception", r"gpl font exception", 0, 0.9),
    ("gpl-with-openssl-exception", "openssl exception", r"(?:with (?:an )?)?openssl exception", 1, 0.8),
    ("gpl-with-linux-syscall-note", "linux syscall note", r"with linux syscall note", 0, 0.95),
    ("lgpl", "received a copy of the gnu lesser general public license", r"you should have received a copy of the gnu lesser general public license along with this library", 0, 0.95),
    ("lgpl-2.1", "spdx license identifier lgpl 2 1", r"spdx license identifier lgpl 2 1(?: only| or later)?", 0, 1.0),
    ("lgpl-3.0", "spdx license identifier lgpl 3 0", r"spdx license identifier lgpl 3 0(?: only| or later)?", 0, 1.0),
    ("agpl", "received a copy of the gnu affero general public license", r"you should have received a copy of the gnu affero general public license along with this program", 0, 0.95),
    ("agpl-3.0", "spdx license identifier agpl 3 0", r"spdx license identifier agpl 3 0(?: only| or later)?", 0, 1.0),
    ("gfdl", "invariant sections no front cover texts", r"with no invariant sections no front cover texts and no back cover texts", 0, 0.95),
    ("bsd", "bsd licence", r"bsd licence", 2, 0.7),
    ("bsd", "berkeley software distribution license", r"berkeley software distribution license", 1, 0.85),
    ("bsd", "bsd licensed", r"bsd licensed", 3, 0.6),
    ("bsd", "redistributions of source code must retain", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 1, 0.9),
    ("bsd", "redistributions in binary form must reproduce", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", 1, 0.9),
    ("bsd-1-clause", "bsd 1 clause", r"bsd 1 clause(?: license)?", 0, 0.95),
    ("bsd-2-clause", "spdx license identifier bsd 2 clause", r"spdx license identifier bsd 2 clause", 0, 1.0),
    ("bsd-2-clause-patent", "bsd 2 clause plus patent", r"bsd 2 clause plus patent(?: license)?", 0, 0.95),
    ("bsd-2-clause-views", "views and conclusions", r"the views and conclusions contained in the software and documentation are those of the authors", 1, 0.85),
    ("bsd-3-clause", "spdx license identifier bsd 3 clause", r"spdx license identifier bsd 3 clause", 0, 1.0),
    ("bsd-3-clause-clear", "clear bsd license", r"(?:the )?clear bsd license", 0, 0.95),
    ("bsd-3-clause-lbnl", "lawrence berkeley national labs bsd", r"lawrence berkeley national labs bsd variant license", 0, 0.95),
    ("bsd-3-clause-no-nuclear", "bsd 3 clause no nuclear", r"bsd 3 clause no nuclear (?:license|warranty)", 0, 0.95),
    ("bsd-protection", "bsd protection license", r"bsd protection license", 0, 0.95),
    ("bsd-source-code", "bsd source code attribution", r"bsd source code attribution", 0, 0.9),
    ("mpl-2.0", "spdx license identifier mpl 2 0", r"spdx license identifier mpl 2 0", 0, 1.0),
    ("mpl-1.1", "subject to the mozilla public license version 1 1", r"the contents of this file are subject to the mozilla public license version 1 1", 0, 1.0),
    ("mpl-2.0-no-copyleft-exception", "incompatible with secondary licenses", r"(?:this source code form is )?incompatible with secondary licenses", 0, 0.95),
    ("npl", "netscape public license", r"netscape public license", 1, 0.95),
    ("nokia", "nokia open source license", r"nokia open source license", 1, 0.95),
    ("spl", "sun public license", r"sun public license", 1, 0.9),
    ("sissl", "sun industry standards source license", r"sun industry standards source license", 1, 0.95),
    ("epl-2.0", "spdx license identifier epl 2 0", r"spdx license identifier epl 2 0", 0, 1.0),
    ("epl", "accompanying materials are made available", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 0, 1.0),
    ("cpal", "common public attribution license", r"common public attribution license", 1, 0.95),
    ("cpol", "code project open license", r"(?:the )?code project open license", 1, 0.95),
    ("cua-opl", "cua office public license", r"cua office public license", 1, 0.95),
    ("rpl", "reciprocal public license", r"reciprocal public license", 1, 0.9),
    ("rpsl", "realnetworks public source license", r"realnetworks public source license", 1, 0.95),
    ("apsl", "apple public source license", r"apple public source license", 1, 0.95),
    ("apl", "adaptive public license", r"adaptive public license", 1, 0.95),
    ("lpl", "lucent public license", r"lucent public license", 1, 0.95),
    ("lppl", "latex project public license", r"latex project public license", 1, 0.95),
    ("lppl", "lppl", r"lppl", 2, 0.7),
    ("motosoto", "motosoto open source license", r"motosoto open source license", 1, 0.95),
    ("multics", "multics license", r"multics license", 1, 0.85),
    ("nasa", "nasa open source agreement", r"nasa open source agreement", 1, 0.95),
    ("naumen", "naumen public license", r"naumen public license", 1, 0.95),
    ("ngpl", "nethack general public license", r"nethack general public license", 0, 0.95),
    ("npsl", "nmap public source license", r"nmap public source license", 1, 0.95),
    ("nposl", "non profit open software license", r"non profit open software license", 0, 0.95),
    ("oclc", "oclc research public license", r"oclc research public license", 1, 0.95),
    ("ogtsl", "open group test suite license", r"open group test suite license", 1, 0.95),
    ("oldap", "openldap public license", r"openldap public license", 1, 0.95),
    ("osl", "licensed under the open software license", r"licensed under the open software license", 1, 0.95),
    ("oset", "oset public license", r"oset public license", 1, 0.95),
    ("ricoh", "ricoh source code public license", r"ricoh source code public license", 1, 0.95),
    ("simpl", "simple public license", r"simple public license", 1, 0.9),
    ("sgi-b", "sgi free software license b", r"sgi free software license b", 1, 0.95),
    ("sil", "sil international license", r"sil international license", 2, 0.7),
    ("sybase", "sybase open watcom public license", r"sybase open watcom public license", 1, 0.95),
    ("vsl", "vovida software license", r"vovida software license", 1, 0.95),
    ("watcom", "open watcom public license", r"open watcom public license", 1, 0.9),
    ("wxwindows", "wxwindows library licen", r"wxwindows library licen[cs]e", 1, 0.95),
    ("xnet", "x net license", r"x net license", 1, 0.85),
    ("entessa", "entessa public license", r"entessa public license", 1, 0.95),
    ("ecl", "educational community license", r"educational community license", 1, 0.95),
    ("efl", "eiffel forum license", r"eiffel forum license", 1, 0.95),
    ("eudatagrid", "eu datagrid software license", r"eu datagrid software license", 1, 0.95),
    ("fair", "fair license", r"(?:the )?fair license", 2, 0.75),
    ("frameworx", "frameworx open license", r"frameworx open license", 1, 0.95),
    ("imatix", "imatix standard function library", r"imatix standard function library agreement", 1, 0.9),
    ("intel", "intel open source license", r"intel open source license", 1, 0.95),
    ("ijg", "independent jpeg group license", r"independent jpeg group license", 1, 0.95),
    ("ijg", "independent jpeg group", r"this software is based in part on the work of the independent jpeg group", 0, 0.95),
    ("jasper", "jasper license", r"jasper license(?: version 2 0)?", 2, 0.8),
    ("miros", "miros licen", r"(?:the )?miros licen[cs]e", 1, 0.9),
    ("naist", "nara institute of science and technology license", r"nara institute of science and technology license", 1, 0.95),
    ("netcdf", "netcdf license", r"netcdf license", 1, 0.85),
    ("newsletr", "newsletr license", r"newsletr license", 1, 0.85),
    ("noweb", "noweb license", r"noweb license", 1, 0.85),
    ("opl", "open publication license", r"open publication license", 1, 0.95),
    ("ogl", "open government licen", r"(?:uk )?open government licen[cs]e", 1, 0.9),
    ("ogl", "public sector information licensed under", r"contains public sector information licensed under the open government licence", 0, 1.0),
    ("etalab", "etalab open license", r"(?:the )?etalab open license", 1, 0.95),
    ("odc", "open data commons", r"open data commons(?: license)?", 3, 0.6),
    ("cdla-permissive", "community data license agreement permissive", r"community data license agreement permissive", 1, 0.95),
    ("cdla-sharing", "community data license agreement sharing", r"community data license agreement sharing", 1, 0.95),
    ("c-uda", "computational use of data agreement", r"computational use of data agreement license", 1, 0.95),
    ("gutenberg", "project gutenberg license", r"(?:full )?project gutenberg license", 1, 0.95),
    ("gutenberg", "project gutenberg license included", r"you may copy it give it away or re use it under the terms of the project gutenberg license included", 0, 1.0),
    ("free-art", "free art license", r"free art license", 1, 0.9),
    ("free-art", "licence art libre", r"licence art libre", 1, 0.9),
    ("dsl", "design science license", r"design science license", 1, 0.9),
    ("against-drm", "against drm license", r"against drm license", 1, 0.9),
    ("gnu-all-permissive", "copying and distribution of this file", r"copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved", 0, 1.0),
    ("gnu-verbatim", "verbatim copying and distribution", r"verbatim copying and distribution of this entire (?:article|document) (?:is|are) permitted in any medium", 0, 0.95),
    ("cc0", "creative commons zero", r"creative commons zero(?: license)?", 1, 0.9),
    ("cc0", "spdx license identifier cc0 1 0", r"spdx license identifier cc0 1 0", 0, 1.0),
    ("cc0", "waived all copyright", r"has waived all copyright and related or neighboring rights", 0, 0.95),
    ("cc", "licensed under a creative commons", r"this work is licensed under a creative commons (?:attribution )?licen[cs]e", 1, 0.9),
    ("cc-pd", "creative commons public domain mark", r"creative commons public domain mark", 0, 0.95),
    ("cc-sampling", "creative commons sampling plus", r"creative commons sampling plus", 0, 0.95),
    ("public-domain", "public domain", r"this (?:work|file|software|document) is in the public domain", 1, 0.9),
    ("public-domain", "no rights reserved", r"no rights reserved", 2, 0.6),
    ("sqlite-blessing", "disclaims copyright to this source code", r"the author disclaims copyright to this source code in place of a legal notice here is a blessing", 0, 1.0),
    ("unlicense", "spdx license identifier unlicense", r"spdx license identifier unlicense", 0, 1.0),
    ("glwtpl", "good luck with that public license", r"good luck with that public license", 0, 0.95),
    ("postcardware", "postcardware license", r"postcardware license", 2, 0.7),
    ("careware", "careware license", r"careware license", 2, 0.7),
    ("bittorrent", "bittorrent open source license", r"bittorrent open source license", 1, 0.95),
    ("blessing", "may you do good and not evil license", r"may you do good and not evil license", 1, 0.9),
    ("borceux", "borceux license", r"borceux license", 1, 0.85),
    ("caldera", "caldera license", r"caldera license", 1, 0.85),
    ("catosl", "computer associates trusted open source license", r"computer associates trusted open source license", 1, 0.95),
    ("cnri-python", "cnri python license", r"cnri python license", 0, 0.95),
    ("cnri-jython", "cnri jython license", r"cnri jython license", 0, 0.95),
    ("condor", "condor public license", r"condor public license", 1, 0.95),
    ("crossword", "crossword license", r"crossword license", 1, 0.85),
    ("crystalstacker", "crystalstacker license", r"crystalstacker license", 1, 0.85),
    ("d-fsl", "german free software license", r"(?:deutsche freie software lizenz )?german free software license", 1, 0.95),
    ("doc", "doc software license", r"doc software license", 1, 0.85),
    ("eurosym", "eurosym license", r"eurosym license", 1, 0.85),
    ("freetype", "freetype project license", r"(?:the )?freetype project license", 1, 0.95),
    ("freetype", "freetype license", r"freetype license", 2, 0.85),
    ("freeimage", "freeimage public license", r"freeimage public license", 1, 0.95),
    ("fsful", "fsf unlimited license", r"fsf unlimited license", 1, 0.95),
    ("giftware", "giftware license", r"giftware license", 2, 0.75),
    ("gl2ps", "gl2ps license", r"gl2ps license", 1, 0.85),
    ("gnuplot", "gnuplot license", r"gnuplot license", 1, 0.85),
    ("haskell-report", "haskell language report license", r"haskell language report license", 1, 0.95),
    ("imagemagick", "imagemagick license", r"imagemagick license", 1, 0.9),
    ("info-zip", "info zip license", r"info zip license", 1, 0.9),
    ("interbase", "interbase public license", r"interbase public license", 1, 0.95),
    ("leptonica", "leptonica license", r"leptonica license", 1, 0.85),
    ("libtiff", "libtiff license", r"libtiff license", 1, 0.85),
    ("makeindex", "makeindex license", r"makeindex license", 1, 0.85),
    ("openpbs", "openpbs software license", r"openpbs software license", 1, 0.9),
    ("phorum", "phorum license", r"phorum license", 1, 0.85),
    ("plexus", "plexus classworlds license", r"plexus classworlds license", 1, 0.9),
    ("qhull", "qhull license", r"qhull license", 1, 0.85),
    ("rdisc", "rdisc license", r"rdisc license", 1, 0.85),
    ("rsa-md", "rsa message digest license", r"rsa message digest license", 1, 0.9),
    ("sax-pd", "sax public domain notice", r"sax public domain notice", 0, 0.95),
    ("scea", "scea shared source license", r"scea shared source license", 1, 0.95),
    ("sendmail", "sendmail license", r"sendmail license", 1, 0.85),
    ("spencer", "spencer license", r"(?:henry )?spencer license", 2, 0.75),
    ("tapr", "tapr open hardware license", r"tapr open hardware license", 1, 0.95),
    ("cern-ohl", "cern open hardware licen", r"cern open hardware licen[cs]e", 1, 0.95),
    ("solderpad", "solderpad hardware license", r"solderpad hardware license", 1, 0.95),
    ("torque", "torque software license", r"torque software license", 1, 0.85),
    ("unicode-tou", "unicode terms of use license", r"unicode terms of use license", 0, 0.9),
    ("w3c", "w3c licen", r"w3c licen[cs]e", 2, 0.8),
    ("x11", "x consortium license", r"x consortium license", 1, 0.85),
    ("xerox", "xerox license", r"xerox license", 1, 0.8),
    ("xfree86", "xfree86 license", r"xfree86 license(?: 1 1)?", 1, 0.85),
    ("yahoo-ypl", "yahoo public license", r"yahoo public license", 1, 0.95),
    ("zed", "zed license", r"zed license", 2, 0.7),
    ("zend", "zend license", r"zend license", 1, 0.85),
    ("zimbra", "zimbra public license", r"zimbra public license", 1, 0.95),
    ("polyform-noncommercial", "polyform noncommercial license", r"polyform noncommercial license", 1, 0.95),
    ("polyform-small-business", "polyform small business license", r"polyform small business license", 1, 0.95),
    ("prosperity", "prosperity public license", r"prosperity public license", 1, 0.95),
    ("parity", "parity public license", r"parity public license", 1, 0.95),
    ("commons-clause", "commons clause license", r"commons clause license(?: condition)?", 1, 0.9),
    ("confluent", "confluent community license", r"confluent community license", 1, 0.95),
    ("timescale", "timescale license", r"timescale license(?: agreement)?", 1, 0.9),
    ("redis", "redis source available license", r"redis source available license", 1, 0.95),
    ("hippocratic", "hippocratic license", r"hippocratic license", 1, 0.95),
    ("anti-996", "anti 996 license", r"anti 996 license", 1, 0.95),
    ("cooperative", "cooperative non violent license", r"cooperative non violent license", 1, 0.9),
    ("openrail", "openrail", r"(?:creativeml )?openrail m(?: license)?", 1, 0.9),
    ("bigscience", "bigscience rail license", r"bigscience rail license", 1, 0.95),
    ("bigcode", "bigcode openrail", r"bigcode openrail m", 0, 0.95),
    ("llama", "llama", r"llama(?: \d)? community license(?: agreement)?", 1, 0.95),
    ("gemma", "gemma terms of use license", r"gemma terms of use license", 1, 0.9),
    ("bcl", "binary code license agreement", r"binary code license agreement", 1, 0.9),
    ("eula", "end user license agreement", r"end user license agreement", 2, 0.6),
    ("eula", "microsoft software license terms", r"microsoft software license terms", 1, 0.9),
    ("proprietary", "commercial license", r"commercial license(?: agreement)?", 3, 0.4),
    ("proprietary", "evaluation license", r"evaluation license(?: agreement)?", 3, 0.4),
    ("proprietary", "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited", 1, 0.8),
    ("shareware", "shareware license", r"shareware license", 2, 0.6),
    ("freeware", "freeware license", r"freeware license", 2, 0.6),
    ("trial", "trial license", r"trial license", 3, 0.4),
    ("cla", "contributor license agreement", r"contributor license agreements?", 3, 0.3),
    ("notice", "licensed under", r"licensed under the terms of", 3, 0.3),
    ("notice", "dual licensed", r"dual licensed", 3, 0.4),
    ("notice", "licensed to you", r"licensed to you under", 3, 0.3),
    ("notice", "warranties or conditions", r"without warranties or conditions of any kind either express or implied", 2, 0.5),
    ("notice", "limitation of liability license", r"limitation of liability license", 3, 0.3),
    ("notice", "license header", r"(?:insert )?license header(?: here)?", 3, 0.3),
)

# Families whose rules follow from name, keyword and versions.
_VERSIONS = {
    "gpl": (r"(?:gnu )?(?:general public license|gpl)", ("general public license", "gpl"), ("1", "2", "3")), "lgpl": (r"(?:gnu )?(?:lesser general public license|library general public license|lgpl)", ("general public license", "lgpl"), ("2", "2 1", "3")), "agpl": (r"(?:gnu )?(?:affero general public license|agpl)", ("affero", "agpl"), ("1", "3")),
    "gfdl": (r"(?:gnu )?(?:free documentation license|gfdl)", ("free documentation license", "gfdl"), ("1 1", "1 2", "1 3")), "apache": (r"apache(?: software)?(?: license)?", ("apache",), ("1", "1 1", "2")), "mpl": (r"(?:mozilla public license|mpl)", ("mozilla public license", "mpl"), ("1", "1 1", "2")),
    "epl": (r"(?:eclipse public license|epl)", ("eclipse public license", "epl"), ("1", "2")), "cpl": (r"common public license", ("common public license",), ("1",)), "cddl": (r"(?:common development and distribution license|cddl)", ("common development and distribution license", "cddl"), ("1", "1 1")),
    "eupl": (r"(?:european union public licen[cs]e|eupl)", ("european union public", "eupl"), ("1", "1 1", "1 2")), "osl": (r"open software license", ("open software license",), ("1", "2", "2 1", "3")), "afl": (r"academic free license", ("academic free license",), ("1 1", "1 2", "2", "2 1", "3")),
    "artistic": (r"artistic license", ("artistic license",), ("1", "2")), "bsl": (r"boost software license", ("boost software license",), ("1",)), "zpl": (r"zope public license", ("zope public license",), ("2", "2 1")), "ofl": (r"open font license", ("open font license",), ("1", "1 1")),
    "php": (r"php license", ("php license",), ("3", "3 01")), "cecill": (r"cecill", ("cecill",), ("1", "2", "2 1")), "python": (r"(?:python software foundation|psf) license", ("python software foundation license", "psf license"), ("2",)),
}
_COMMONS = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s(?: works)?", "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?"}


def rules() -> list[Rule]:
    """All signature rules in order: over 300 written one by one above, and those of families with versions."""
    out = [Rule(label, *rest) for label, found in _NAMED.items() for rest in found] + [Rule(*x) for x in _MORE]
    for label, (name, keywords, versions) in _VERSIONS.items():
        for v in versions:
            number = v if " " in v else f"{v}(?: 0)?"
            tag = f"{label}-{v.replace(' ', '.') if ' ' in v else v + '.0'}"
            for keyword in keywords:
                out.append(Rule(f"{tag}", keyword, rf"{name}(?: (?:version|v))? v?{number}", 1, 0.95))
                if label in ("gpl", "lgpl", "agpl"):
                    out.append(Rule(f"{tag}-or-later", keyword, rf"{name}(?: as published by the free software foundation)? (?:either )?(?:version|v)? ?v?{number} (?:of the license )?or (?:at your option )?any later version", 0, 1.0))
                    out.append(Rule(f"{tag}-only", keyword, rf"{name}(?: (?:version|v))? v?{number} only", 0, 1.0))
    for label, name in _COMMONS.items():
        for v in ("1", "2", "2 5", "3", "4"):
            tag, number = f"cc-{label}-{v.replace(' ', '.') if ' ' in v else v + '.0'}", v if " " in v else f"{v}(?: 0)?"
            out.append(Rule(tag, "creative commons", rf"creative commons {name} (?:version )?{number}(?: (?:international|unported|generic))?(?: (?:public )?license)?", 0, 1.0))
            out.append(Rule(tag, f"cc {label.replace('-', ' ')}", rf"cc {label.replace('-', ' ')} {number}", 0, 0.95))
        out.append(Rule(f"cc-{label}", "creative commons", rf"creative commons {name}(?: (?:public )?license)?", 1, 0.9))
        out.append(Rule(f"cc-{label}", f"cc {label.replace('-', ' ')}", rf"cc {label.replace('-', ' ')}", 2, 0.7))
    return out


#: Each keyword has one of these; a text without any of them has no detection.
GATE = ("licen", "gpl", "gfdl", "bsd", "cddl", "eupl", "odbl", "sspl", "wtfpl", "apache", " mpl", " epl", "cecill", " cc by", " cc0", "creative commons", "public domain", "data commons", "copyright", "copyleft", "warranty", "redistribution", "permission", "reserved", "proprietary", "promote", "advertising materials", "free of charge", "restriction", "no attribution", "source code form", "x consortium", "same terms as", " as is", "what the fuck", "openssl toolkit", "w3c software", " ms pl", "mulan", "good not evil", "affero", "european union public", "free software", "illinois ncsa",
        " under the mit", "carnegie mellon", "supporting documentation", "disclaims", " asf under", "applicable law", " exception", "linking this library", "bison parser", "syscall", "invariant sections", "views and conclusions", "accompanying materials", " lppl", "nasa open source", "imatix", "jpeg group", "use of data agreement", "copying and distribution", "openrail", "unauthorized copying", "warranties", " llama")
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MARK = "\x01"


def word_string(text: Column) -> Column:
    """' word word ... ': lower-cased, whatever is no word one space. A text without words gives one space.

    Letters outside ASCII are in words whatever their case; the two that become ASCII ones (Kelvin's K, and a dotted capital I, which keeps its
    dot as a character) make no word of a base phrase.
    """
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), SEPARATORS, " ")


def count_words(joined: Column) -> Column:
    """Words between the single spaces of a string, by its spaces."""
    return F.length(joined) - F.length(F.replace(joined, F.lit(" "), F.lit("")))


def bounded(pattern: Column) -> Column:
    """The pattern between two spaces, which it leaves to its neighbours."""
    return F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))


def intervals(joined: Column, pattern: Column) -> Column:
    """array<struct<start, end>>: the words of each match, leftmost and non-overlapping. The first word of each is marked, and marks are found by word."""
    pattern = bounded(pattern)
    marked = F.split(F.regexp_replace(joined, pattern, F.lit(MARK + "$0")), " ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(w.startswith(MARK), i - 1)), lambda i: i.isNotNull())
    return F.zip_with(starts, F.regexp_extract_all(joined, pattern, F.lit(0)), lambda a, m: F.struct(a.cast("long").alias("start"), (a + count_words(m) + 1).cast("long").alias("end")))


def scan(docs: DataFrame, more: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, base, found, labels, score): detections in every whole text, without a shuffle.

    base: array<struct<label, start, end>> of the base phrases, which are never suppressed. found: the same for the signature rules, with
    priority and weight; labels: distinct labels of base and of what isn't suppressed, sorted; score: the largest weight of those, 0 without any.
    Of equal intervals, that of the first rule in order stays among equal priorities. Null texts count as empty; rows that repeat a doc_id each get a row.
    """
    own = rules() if more is None else more
    table = F.array(*(F.struct(F.lit(r.label).alias("label"), F.lit(f" {r.keyword}").alias("keyword"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(float(r.weight)).alias("weight"), F.lit(k).alias("rule")) for k, r in enumerate(own)))
    keywords = {r.keyword for r in own} | {phrase for _, phrase in BASE}
    roots = [*(x for x in GATE if any(x in f" {k}" for k in keywords)), *sorted(k for k in keywords if not any(x in f" {k}" for x in GATE))]
    gate = functools.reduce(lambda a, b: a | b, (F.contains(F.col("joined"), F.lit(x)) for x in roots))
    d = common.texts(docs, id_col, text_col).select("doc_id", word_string(F.col("text")).alias("joined"))
    d = d.select("doc_id", "joined", F.greatest(count_words(F.col("joined")) - 1, F.lit(0)).cast("long").alias("n_words"), gate.alias("gated"))
    none = "array<struct<label:string,start:bigint,end:bigint>>"

    def of_phrase(label: str, phrase: str) -> Column:
        return F.transform(intervals(F.col("joined"), F.lit(phrase)), lambda x: F.struct(F.lit(label).alias("label"), x["start"].alias("start"), x["end"].alias("end")))

    bases = F.flatten(F.array(*(of_phrase(label, phrase) for label, phrase in BASE)))

    def of_rule(r: Column) -> Column:
        return F.transform(intervals(F.col("joined"), r["pattern"]), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["weight"].alias("weight")))

    there = F.filter(table, lambda r: F.contains(F.col("joined"), r["keyword"]) & F.regexp_like(F.col("joined"), bounded(r["pattern"])))
    found = F.sort_array(F.flatten(F.transform(there, of_rule)))
    kind = "array<struct<start:bigint,back:bigint,priority:int,rule:int,label:string,weight:double>>"
    d = d.select("doc_id", "n_words", F.when(F.col("gated"), bases).otherwise(F.from_json(F.lit("[]"), none)).alias("base"), F.when(F.col("gated"), found).otherwise(F.from_json(F.lit("[]"), kind)).alias("found"))
    # By start, longest first: an earlier one contains a later one if it ends no sooner. reach: the furthest end so far by priority.
    tiers = sorted({r.priority for r in own})
    start = F.struct(*(F.lit(-1).cast("long").alias(f"reach{t}") for t in tiers), F.expr("cast(array() as array<string>)").alias("labels"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        end = -x["back"]
        over = F.lit(False)
        for t in tiers:
            over = over | ((x["priority"] >= t) & (acc[f"reach{t}"] >= end))
        reach = [F.when((x["priority"] == t) & (acc[f"reach{t}"] < end), end).otherwise(acc[f"reach{t}"]).alias(f"reach{t}") for t in tiers]
        labels = F.when(over | F.array_contains(acc["labels"], x["label"]), acc["labels"]).otherwise(F.array_append(acc["labels"], x["label"]))
        return F.struct(*reach, labels.alias("labels"), F.when(over, acc["score"]).otherwise(F.greatest(acc["score"], x["weight"])).alias("score"), (acc["n"] + F.when(over, 0).otherwise(1)).alias("n"))

    kept = F.when(F.size("found") > 0, F.aggregate("found", start, step))
    d = d.withColumn("kept", kept)
    named = F.transform("base", lambda x: x["label"])
    labels = F.sort_array(F.array_distinct(F.concat(named, F.coalesce(F.col("kept.labels"), F.expr("cast(array() as array<string>)")))))
    return d.select("doc_id", "n_words", "base", "found", labels.alias("labels"), F.coalesce(F.col("kept.score"), F.lit(0.0)).alias("score"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.transform("base", lambda x: x["start"])
    return scan(common.documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
