"""Signatures: what license texts say, as regexes over normalised words (lower case, single spaces).

Each is written by hand from the public text of a license: its label, and the regex, which
begins with plain words. Gaps are counted in words, so that every signature has a finite
reach. Of the plain words in front the longest is the keyword that gates a signature; one
with `|` between texts is gated by a keyword for each.
"""

from __future__ import annotations

# Fixed texts: label, regex.
SIGNATURES = [
    # MIT and its kin
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", r"use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", r"permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", r"merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders"),
    ("mit-0", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-advertising", r"all advertising materials mentioning features or use of this software must include the following acknowledgement"),
    ("x11", r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("boost", r"unless such copies or derivative works are solely in the form of machine executable object code"),
    ("boost", r"free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", r"the author disclaims all warranties with regard to this software including all implied warranties"),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("hpnd", r"not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    ("ntp", r"for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies"),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided"),
    ("postgresql", r"without fee and without a written agreement is hereby granted"),
    ("postgresql", r"in no event shall the university of california be liable|the regents of the university of california"),
    ("unicode", r"unicode inc license agreement data files and software"),
    ("unicode", r"unicode data files and any associated documentation"),
    # BSD
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted provided"),
    ("bsd", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", r"must display the following acknowledge?ment this product includes software developed by"),
    ("bsd-2-clause", r"views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd-3-clause-clear", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd", r"this software is provided by the copyright holders and contributors as is"),
    ("bsd", r"procurement of substitute goods or services loss of use data or profits or business interruption"),
    ("ncsa", r"university of illinois at urbana champaign"),
    ("ncsa", r"must retain the above copyright notice this list of conditions and the following disclaimers"),
    ("intel", r"neither the name of the intel corporation nor the names of its contributors"),
    # Apache
    ("apache-2.0", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance"),
    ("apache-2.0", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", r"you may obtain a copy of the license at(?: https?)? www apache org licenses license 2 0"),
    ("apache-2.0", r"without warranties or conditions of any kind either express or implied see the license for the specific language"),
    ("apache-2.0", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-2.0", r"terms and conditions for use reproduction and distribution"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation"),
    ("apache-1.1", r"products derived from this software may not be called apache"),
    ("apache-1.0", r"this product includes software developed by the apache group"),
    # GPL
    ("gpl", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", r"you may not impose any further restrictions on the recipients exercise of the rights granted herein|for the programs that you develop"),
    ("gpl", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", r"you should have received a copy of the gnu general public license along with"),
    ("gpl-2.0", r"gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3.0", r"gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2.0", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", r"installation information for a user product means"),
    ("gpl-3.0", r"to propagate a work means to do anything with it that without permission"),
    ("gpl-3.0", r"to convey a work means any kind of propagation that enables other parties"),
    ("lgpl", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", r"you can redistribute it and or modify it under the terms of the gnu library general public license"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", r"this license the lesser general public license applies to some specially designated software packages"),
    ("lgpl-3.0", r"this version of the gnu lesser general public license incorporates the terms and conditions"),
    ("agpl", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl", r"you should have received a copy of the gnu affero general public license"),
    ("agpl-3.0", r"all users interacting with it remotely through a computer network"),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gpl-classpath", r"gnu classpath exception|classpath exception to the gpl"),
    ("gpl-linking", r"linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl-bison", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-autoconf", r"as a special exception the free software foundation gives unlimited permission to copy distribute and modify the configure scripts"),
    ("gcc-exception", r"gcc runtime library exception"),
    ("fsf-unlimited", r"gives unlimited permission to copy and or distribute it with or without modifications"),
    # Mozilla, Eclipse, Common
    ("mpl-2.0", r"subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", r"incompatible with secondary licenses"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("npl-1.1", r"the contents of this file are subject to the netscape public license"),
    ("epl-2.0", r"made available under the terms of the eclipse public license 2 0"),
    ("epl-1.0", r"made available under the terms of the eclipse public license v1 0"),
    ("epl", r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("cddl", r"subject to the terms of the common development and distribution license"),
    ("cpl-1.0", r"accompanying program is provided under the terms of this common public license"),
    ("ipl-1.0", r"the accompanying program is provided under the terms of this ibm public license"),
    ("apsl", r"subject to the apple public source license version"),
    ("rpl", r"subject to the reciprocal public license"),
    ("qpl", r"the q public license version 1 0"),
    ("sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("eupl", r"licensed under the eupl|licensed under the european union public licen[cs]e|licenced under the european union public licen[cs]e"),
    ("cecill", r"ce logiciel est regi par la licence cecill|governed by the cecill(?: [abc])? license"),
    ("osl", r"licensed under the open software license version"),
    ("afl", r"licensed under the academic free license version"),
    ("artistic", r"under the same terms as perl itself|the artistic license preamble"),
    ("artistic-1.0", r"copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", r"everyone is permitted to copy and distribute verbatim copies of this license document the artistic license"),
    ("perl", r"you can redistribute it and or modify it under the same terms as perl itself"),
    ("ruby", r"you can redistribute it and or modify it under either the terms of the 2 clause bsdl|the same terms as ruby"),
    ("php-3.01", r"this product includes php software freely available from"),
    ("php-3.01", r"this source file is subject to version 3 01 of the php license"),
    ("psf", r"psf is making python available to licensee on an as is basis"),
    ("psf", r"python software foundation license version 2"),
    ("cnri", r"cnri grants licensee a nonexclusive royalty free world wide license"),
    ("zpl-2.1", r"zope public license(?: zpl)?(?: version)? 2 1"),
    ("w3c", r"w3c software notice and license|w3c software and document (?:notice and )?license"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", r"this product includes cryptographic software written by eric young"),
    ("zlib", r"altered source versions must be plainly marked as such"),
    ("zlib", r"the origin of this software must not be misrepresented"),
    ("libpng", r"the png reference library is supplied as is"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", r"portions of this software are copyright(?: \S+){0,3} the freetype project"),
    ("bzip2", r"this program bzip2 and the associated library libbzip2"),
    ("sqlite", r"may you do good and not evil may you find forgiveness for yourself and forgive others"),
    ("json", r"the software shall be used for good not evil"),
    ("beerware", r"you can buy me a beer in return|beer ware license"),
    ("wtfpl", r"do what the fuck you want to public license"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", r"in perpetuity of all present and future rights to this software under copyright law"),
    ("public-domain", r"this (?:file|code|software|work|program) is (?:hereby )?(?:placed )?in the public domain"),
    ("public-domain", r"released (?:in|into|to) the public domain|dedicated (?:in|into|to) the public domain|placed (?:in|into|to) the public domain"),
    ("public-domain", r"waived all copyright(?: \S+){0,8} to the public domain|dedicates (?:this|the) work to the public domain"),
    ("upl-1.0", r"the larger works? to which the software is contributed|universal permissive license"),
    ("vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("tcl", r"this software is copyrighted by the regents of the university of california sun microsystems"),
    ("xfree86", r"this product includes software developed by the xfree86 project"),
    ("icu", r"icu license icu 1 8 1 and later"),
    ("naist", r"nara institute of science and technology"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", r"with reserved font name"),
    ("ubuntu-font", r"ubuntu font licen[cs]e version 1 0"),
    ("bitstream-vera", r"bitstream vera is a trademark of bitstream inc"),
    # Creative Commons and open data
    ("cc-by", r"this work is licensed under a creative commons attribution(?: \d \d)?(?: international| unported)? license"),
    ("cc-by-sa", r"creative commons attribution share ?alike(?: \d \d)?(?: international| unported)? license"),
    ("cc-by-nc", r"creative commons attribution non ?commercial(?: \d \d)?(?: international| unported)? license"),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: \d \d)?(?: international| unported)? license"),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike(?: \d \d)?(?: international| unported)? license"),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: \d \d)?(?: international| unported)? license"),
    ("cc-by", r"creativecommons org licenses by \d \d"),
    ("cc-by-sa", r"creativecommons org licenses by sa \d \d"),
    ("cc-by-nc", r"creativecommons org licenses by nc \d \d"),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa \d \d"),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd \d \d"),
    ("cc-by-nd", r"creativecommons org licenses by nd \d \d"),
    ("cc0-1.0", r"creativecommons org publicdomain zero 1 0"),
    ("cc0-1.0", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("cc0-1.0", r"to the extent possible under law(?: \S+){1,8} has waived all copyright and related or neighboring rights"),
    ("odbl-1.0", r"made available under the open database license"),
    ("odc-by-1.0", r"made available under the open data commons attribution license"),
    ("pddl-1.0", r"made available under the public domain dedication and license"),
    ("ogl-uk", r"contains public sector information licensed under the open government licence"),
    ("ogl-canada", r"contains information licensed under the open government licence canada"),
    ("etalab", r"licence ouverte(?: open licence)? etalab|etalab open licence"),
    ("dl-de-by", r"datenlizenz deutschland namensnennung"),
    ("cdla-permissive", r"community data license agreement permissive"),
    ("cdla-sharing", r"community data license agreement sharing"),
    ("openrail", r"responsible ai license|open rail m? ?license"),
    ("wikipedia", r"text is available under the creative commons attribution share ?alike license"),
    ("crown", r"crown copyright(?: \d{4})?(?: \S+){0,4}? reproduced with (?:the )?permission"),
    # Source-available and proprietary
    ("sspl-1.0", r"offering the program as a service you must make the service source code available"),
    ("busl-1.1", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", r"commons clause license condition v1 0"),
    ("polyform-noncommercial", r"polyform noncommercial license"),
    ("polyform-small", r"polyform small business license"),
    ("polyform-shield", r"polyform shield license"),
    ("confluent", r"confluent community license"),
    ("timescale", r"licensed under the timescale license|tsl license agreement"),
    ("ms-pl", r"this license governs use of the accompanying software(?: \S+){0,12}? microsoft public license|microsoft public license ms pl"),
    ("ms-eula", r"microsoft software license terms"),
    ("proprietary", r"proprietary and confidential"),
    ("proprietary", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", r"unauthorized (?:reproduction|copying|use|distribution)(?: or (?:reproduction|copying|use|distribution))? (?:of this \S+ )?is (?:strictly )?prohibited"),
    ("proprietary", r"without the (?:prior )?(?:express )?written (?:consent|permission) of"),
    ("proprietary", r"you may not reverse engineer decompile or disassemble"),
    ("proprietary", r"end user license agreement eula"),
    ("proprietary", r"this software is licensed not sold"),
    ("nvidia", r"nvidia corporation and its licensors retain all intellectual property"),
    ("oracle", r"oracle and or its affiliates all rights reserved"),
    ("adobe", r"adobe systems incorporated all rights reserved notice adobe permits you to use"),
    ("us-government", r"this is a work of the u ?s government and is not subject to copyright protection"),
    ("reserved", r"copyright (?:c )?(?:\S+ ){0,80}?all rights reserved"),
    ("press", r"may not be published broadcast rewritten or redistributed"),
    ("press", r"no part of this (?:publication|book|work|document) may be reproduced"),
    ("noncommercial", r"for personal use only|for academic use only|for research use only|for personal and educational use only|for research and educational (?:use|purposes) only"),
    ("noncommercial", r"not for commercial use|non commercial use only|for non commercial (?:use|purposes) only"),
    ("no-derivatives", r"no derivative works (?:may be|are) (?:made|permitted|allowed)"),
    ("attribution", r"free to use with attribution|attribution is required"),
]
