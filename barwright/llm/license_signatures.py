"""Sentences of licence texts and notices, written by hand: label, regex (a space stands for any white space), keyword.

Every match of a regex holds its keyword and one of ``license_scan.GATES`` (lower case, single spaces).
"""

NOTICES = [
    # permissive
    ("MIT", r"Permission is hereby granted, free of charge, to any person obtaining a copy", "permission is hereby"),
    ("MIT", r"Permission is hereby granted, free of charge, to any person", "permission is hereby"),
    ("MIT", r"The above copyright notice and this permission notice shall be included in all copies or substantial portions", "permission notice shall"),
    ("MIT", r"subject to the following conditions: The above copyright notice and this permission notice", "this permission notice"),
    ("MIT-0", r"to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so\. THE SOFTWARE", "sublicense, and/or sell"),
    ("X11", r"Except as contained in this notice, the name of the X Consortium shall not be used in advertising", "x consortium"),
    ("ISC", r"Permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted", "permission to use"),
    ("ISC", r"Permission to use, copy, modify, and(?:/or)? distribute this software", "permission to use"),
    ("0BSD", r"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. THE SOFTWARE IS PROVIDED", "permission to use"),
    ("HPND", r"Permission to use, copy, modify and distribute this software and its documentation for any purpose", "permission to use"),
    ("HPND-sell", r"Permission to use, copy, modify, distribute, and sell this software and its documentation", "permission to use"),
    ("NTP", r"Permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee", "permission to use"),
    ("BSD", r"Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution and use"),
    ("BSD", r"Redistribution and use in source and binary forms", "redistribution and use"),
    ("BSD", r"Redistributions of source code must retain the above copyright notice", "redistributions of source"),
    ("BSD", r"Redistributions in binary form must reproduce the above copyright notice", "redistributions in binary"),
    ("BSD-3-Clause", r"Neither the name of (?:the )?[A-Za-z0-9 .,<>-]{1,80} nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software without specific prior written permission", "nor the names of"),
    ("BSD-4-Clause", r"All advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment: This product includes software developed by [^.]{1,120}", "all advertising materials"),
    ("BSD-Patent", r"Subject to the terms and conditions of this license, each copyright holder and contributor hereby grants", "each copyright holder"),
    ("BSD-Source-Code", r"Redistribution of this software in source code form must retain", "redistribution of this software"),
    ("Apache-1.1", r"Products derived from this software may not be called \"Apache\", nor may \"Apache\" appear in their name, without prior written permission", "may not be called"),
    ("Apache-2.0", r"TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1\. Definitions\. \"License\"", "for use, reproduction"),
    ("Apache-2.0", r"You may obtain a copy of the License at https?://www\.apache\.org/licenses/LICENSE-2\.0", "license-2.0"),
    ("Apache-2.0", r"you may not use this file except in compliance with the License", "in compliance with the license"),
    ("Apache-2.0", r"Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS", "unless required by applicable"),
    ("Zlib", r"This software is provided 'as-is', without any express or implied warranty\. In no event will the authors be held liable", "without any express or implied warranty"),
    ("Zlib", r"Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software\. (?:3\. )?This notice may not be removed or altered from any source distribution", "altered source versions"),
    ("Libpng", r"Permission is hereby granted to use, copy, modify, and distribute this source code, or portions hereof, for any purpose, without fee", "permission is hereby"),
    ("BSL-1.0", r"Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "person or organization"),
    ("Curl", r"Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies\. THE SOFTWARE", "permission to use"),
    ("PostgreSQL", r"Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", "without a written agreement"),
    ("NCSA", r"to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense", "to deal with the software"),
    ("Unicode-DFS", r"Permission is hereby granted, free of charge, to any person obtaining a copy of the Unicode data files", "unicode data files"),
    ("ICU", r"provided that the above copyright notice\(s\) and this permission notice appear in all copies of the Software and that both the above copyright notice\(s\)", "notice(s) and this permission"),
    ("W3C", r"By obtaining, using and/or copying this work, you \(the licensee\) agree that you have read, understood, and will comply", "you (the licensee)"),
    ("FSFAP", r"Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice", "copying and distribution of this file"),
    ("FSFUL", r"This configure script is free software; the Free Software Foundation gives unlimited permission to copy, distribute and modify it", "gives unlimited permission"),
    ("FSFULLR", r"This file is free software; the Free Software Foundation gives unlimited permission to copy and/or distribute it, with or without modifications", "gives unlimited permission"),
    ("Beerware", r"As long as you retain this notice you can do whatever you want with this stuff\. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return", "buy me a beer"),
    ("WTFPL", r"DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS", "do what the fuck"),
    ("WTFPL", r"Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed", "changing it is allowed"),
    ("JSON", r"The Software shall be used for Good, not Evil", "for good, not evil"),
    ("Info-ZIP", r"Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the above disclaimer", "the above disclaimer"),
    ("Zlib", r"Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "permission is granted to anyone"),
    ("Bzip2", r"The origin of this software must not be misrepresented; you must not claim that you wrote the original software\. If you use this software in a product, an acknowledg(?:e)?ment in the product documentation would be appreciated but is not required", "must not be misrepresented"),
    ("OpenSSL", r"This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit\. \(http://www\.openssl\.org/\)\"", "openssl toolkit"),
    ("SSLeay", r"The licen[cs]e and distribution terms for any publically available version or derivative of this code cannot be changed", "publically available version"),
    ("PHP-3.01", r"This product includes PHP software, freely available from <?https?://www\.php\.net/software/>?", "php software, freely"),
    ("Python-2.0", r"PSF hereby grants Licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test", "psf hereby grants"),
    ("CNRI-Python", r"CNRI hereby grants Licensee a nonexclusive, royalty-free, world-wide license", "cnri hereby grants"),
    ("TCL", r"The authors hereby grant permission to use, copy, modify, distribute, and license this software and its documentation for any purpose", "hereby grant permission to use"),
    ("Vim", r"There are no restrictions on distributing unmodified copies of Vim except that they must include this license text", "unmodified copies of vim"),
    ("Ruby", r"You may make and give away verbatim copies of the source form of the software without restriction, provided that you duplicate all of the original copyright notices", "verbatim copies of the source form"),
    ("Artistic-1.0", r"The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control", "semblance of artistic control"),
    ("Artistic-2.0", r"This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed", "terms under which a given"),
    ("AFL-3.0", r"Licensed under the Academic Free License version 3\.0", "academic free"),
    ("OSL-3.0", r"Licensed under the Open Software License version 3\.0", "open software"),
    ("ECL-2.0", r"Licensed under the Educational Community License, Version 2\.0", "educational community"),
    ("UPL-1.0", r"The Universal Permissive License \(UPL\),? Version 1\.0", "universal permissive"),
    ("BlueOak-1.0.0", r"Blue Oak Model License(?: Version 1\.0\.0)?", "blue oak"),
    ("MulanPSL-2.0", r"Mulan Permissive Software License,?\s*(?:Version 2|v2)", "mulan permissive"),
    # copyleft
    ("GPL", r"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License", "redistribute it and/or modify"),
    ("GPL-2.0", r"either version 2 of the License, or \(at your option\) any later version", "version 2 of the license"),
    ("GPL-3.0", r"either version 3 of the License, or \(at your option\) any later version", "version 3 of the license"),
    ("GPL", r"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY", "in the hope that it will be useful"),
    ("GPL", r"You should have received a copy of the GNU General Public License along with this program", "should have received a copy"),
    ("GPL-2.0", r"GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "version 2, june 1991"),
    ("GPL-3.0", r"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "version 3, 29 june 2007"),
    ("LGPL-2.0", r"GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991", "gnu library general"),
    ("LGPL-2.1", r"GNU LESSER GENERAL PUBLIC LICENSE Version 2\.1, February 1999", "version 2.1, february 1999"),
    ("LGPL-3.0", r"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "gnu lesser general"),
    ("LGPL", r"This library is free software; you can redistribute it and/or modify it under the terms of the GNU (?:Lesser|Library) General Public License", "this library is free"),
    ("LGPL", r"You should have received a copy of the GNU (?:Lesser|Library) General Public License along with this library", "along with this library"),
    ("AGPL-3.0", r"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "19 november 2007"),
    ("AGPL", r"You should have received a copy of the GNU Affero General Public License", "gnu affero"),
    ("GPL-Classpath", r"As a special exception, the copyright holders of this library give you permission to link this library with independent modules", "permission to link this library"),
    ("GCC-exception", r"Under Section 7 of GPL version 3, you are granted additional permissions described in the GCC Runtime Library Exception", "gcc runtime library"),
    ("GFDL", r"Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License", "modify this document"),
    ("GFDL", r"with no Invariant Sections, (?:with )?no Front-Cover Texts,? and (?:with )?no Back-Cover Texts\. A copy of the license", "no invariant sections"),
    ("MPL-1.1", r"The contents of this file are subject to the Mozilla Public License Version 1\.1", "are subject to the mozilla"),
    ("MPL-2.0", r"This Source Code Form is subject to the terms of the Mozilla Public License, v\. 2\.0", "source code form is subject"),
    ("MPL-2.0", r"This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License", "incompatible with secondary"),
    ("EPL-1.0", r"This program and the accompanying materials are made available under the terms of the Eclipse Public License v1\.0", "eclipse public license v1.0"),
    ("EPL-2.0", r"This program and the accompanying materials are made available under the terms of the Eclipse Public License (?:v\. )?2\.0", "eclipse public license"),
    ("CDDL-1.0", r"The contents of this file are subject to the terms of the Common Development and Distribution License", "common development and distribution"),
    ("CPL-1.0", r"THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS COMMON PUBLIC LICENSE", "this common public license"),
    ("IPL-1.0", r"THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS IBM PUBLIC LICENSE", "this ibm public license"),
    ("EUPL-1.2", r"Licensed under the EUPL,? (?:Version 1\.2|v1\.2|V\.1\.2)", "under the eupl"),
    ("CeCILL", r"This software is governed by the CeCILL(?:-[BC])? license under French law", "cecill"),
    ("QPL-1.0", r"THE Q PUBLIC LICENSE version 1\.0", "q public license"),
    ("NPL-1.1", r"subject to the Netscape Public License Version 1\.1", "netscape public"),
    ("APSL-2.0", r"subject to the Apple Public Source License Version 2\.0", "apple public source"),
    ("SSPL-1.0", r"If you make the functionality of the Program or a modified version available to third parties as a service, you must make the Service Source Code available[^.]{0,160} under the terms of this License", "service source code available"),
    ("OFL-1.1", r"This Font Software is licensed under the SIL Open Font License, Version 1\.1", "sil open font"),
    ("OFL-1.1", r"The Font Software may be sold as part of a larger software package but no copy of one or more of the Font Software typefaces may be sold by itself", "larger software package"),
    ("LPPL-1.3c", r"This work may be distributed and/or modified under the conditions of the LaTeX Project Public License", "latex project public"),
    ("RPL-1.5", r"Reciprocal Public License (?:\(\"RPL\"\) )?(?:1\.5|Version 1\.5)", "reciprocal public"),
    ("Sleepycat", r"Redistributions in any form must be accompanied by information on how to obtain complete source code for the DB software", "complete source code for the db"),
    # data, documents and models
    ("CC-BY-4.0", r"This work is licensed under a Creative Commons Attribution 4\.0 International License", "creative commons attribution 4.0"),
    ("CC-BY-SA-4.0", r"This work is licensed under a Creative Commons Attribution-ShareAlike 4\.0 International License", "attribution-sharealike 4.0"),
    ("CC-BY-SA-3.0", r"Text is available under the Creative Commons Attribution-ShareAlike License", "text is available under"),
    ("CC-BY", r"creativecommons\.org/licenses/by/[1-4]\.[05]", "creativecommons.org/licenses/by/"),
    ("CC-BY-SA", r"creativecommons\.org/licenses/by-sa/[1-4]\.[05]", "creativecommons.org/licenses/by-sa/"),
    ("CC-BY-NC", r"creativecommons\.org/licenses/by-nc/[1-4]\.[05]", "creativecommons.org/licenses/by-nc/"),
    ("CC-BY-ND", r"creativecommons\.org/licenses/by-nd/[1-4]\.[05]", "creativecommons.org/licenses/by-nd/"),
    ("CC-BY-NC-SA", r"creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]", "creativecommons.org/licenses/by-nc-sa/"),
    ("CC-BY-NC-ND", r"creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]", "creativecommons.org/licenses/by-nc-nd/"),
    ("CC0-1.0", r"To the extent possible under law, [^.]{1,120} has waived all copyright and related or neighboring rights", "has waived all copyright"),
    ("ODbL-1.0", r"made available under the Open Database License: https?://opendatacommons\.org/licenses/odbl", "open database license"),
    ("ODC-By-1.0", r"made available under the Open Data Commons Attribution License", "open data commons attribution"),
    ("PDDL-1.0", r"made available under the Public Domain Dedication and License", "public domain dedication"),
    ("CDLA-Permissive", r"Community Data License Agreement (?:–|-) Permissive", "community data license"),
    ("CDLA-Sharing", r"Community Data License Agreement (?:–|-) Sharing", "community data license"),
    ("OGL-UK", r"Contains public sector information licensed under the Open Government Licence", "open government licence"),
    ("OpenRAIL", r"(?:CreativeML|BigScience) Open\s*RAIL-M", "rail-m"),
    ("Llama", r"is licensed under the (?:LLAMA|Llama) [23](?:\.[0-9])? Community License", "community license"),
    # public domain and proprietary
    ("Public-Domain", r"(?:released|dedicated|placed) (?:in|in?to) the public domain", "public domain"),
    ("Public-Domain", r"This (?:file|code|software|work|program) is (?:hereby )?(?:in|placed in) the public domain", "public domain"),
    ("Unlicense", r"This is free and unencumbered software", "unencumbered"),
    ("Unlicense", r"Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software[^.]{0,200}", "anyone is free to copy"),
    ("SQLite-blessing", r"The author disclaims copyright to this source code", "disclaims copyright"),
    ("Proprietary", r"All rights reserved", "all rights reserved"),
    ("Proprietary", r"This software is (?:the )?(?:proprietary and confidential|confidential and proprietary)", "confidential"),
    ("Proprietary", r"Unauthorized (?:copying|reproduction|use|distribution) of this software,? (?:via any medium )?is strictly prohibited", "strictly prohibited"),
    ("Proprietary", r"may not be reproduced or distributed without (?:the )?(?:prior|express) written permission", "may not be reproduced"),
    ("BUSL-1.1", r"Licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the Licensed Work", "non-production use"),
    ("Elastic-2.0", r"You may not provide the software to third parties as a hosted or managed service, where the service provides users with access to any substantial set of the features or functionality of the software", "hosted or managed service"),
    ("Commons-Clause", r"\"Commons Clause\" License Condition v1\.0", "commons clause"),
    ("PolyForm-NC", r"PolyForm Noncommercial License 1\.0\.0", "polyform noncommercial"),
    ("Ethical-Source", r"(?:Hippocratic|Anti-996) License", "c license|6 license"),
]
