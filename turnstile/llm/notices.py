"""Texts by which licenses are told: names, headers and openings of bodies, by version.

Passages of up to a hundred words stand for whole bodies, as they are what tells them
apart.  The order has no meaning.
"""

VERBATIM = ("Everyone is permitted to copy and distribute verbatim copies of this license document, but "
            "changing it is not allowed.")
FREE = "is free software{} you can redistribute it and/or modify it under the terms of the GNU"
LATER = "as published by the Free Software Foundation{} either version {} of the License, or (at your option) " \
        "any later version."
FREEDOM = ("The licenses for most software are designed to take away your freedom to share and change it. By "
           "contrast, the GNU General Public License{} intended to guarantee your freedom to share and change free "
           "software--to make sure the software is free for all its users.")

GNU = [
    ("GPL-1.0", f"GNU GENERAL PUBLIC LICENSE Version 1, February 1989 {VERBATIM} Preamble The license agreements of "
                "most software companies try to keep users at the mercy of those companies. By contrast, our General "
                "Public License is intended to guarantee your freedom to share and change free software"),
    ("GPL-1.0", f"This program {FREE.format(';')} General Public License as published by the Free Software "
                "Foundation; either version 1, or (at your option) any later version."),
    ("GPL-1.0", "This work is licensed under the GNU General Public License, version 1"),
    ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 {VERBATIM} Preamble {FREEDOM.format(' is')}"),
    ("GPL-2.0", f"This program {FREE.format(';')} General Public License {LATER.format(';', '2')}"),
    ("GPL-2.0", f"This program {FREE.format(';')} General Public License version 2 as published by the Free "
                "Software Foundation."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {VERBATIM} Preamble The GNU General Public "
                "License is a free, copyleft license for software and other kinds of works."),
    ("GPL-3.0", f"This program {FREE.format(':')} General Public License {LATER.format(',', '3')}"),
    ("GPL-3.0", f"This program {FREE.format(':')} General Public License version 3 as published by the Free "
                "Software Foundation."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-2.0", f"GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991 {VERBATIM} [This is the first released "
                 "version of the library GPL. It is numbered 2 because it goes with version 2 of the ordinary GPL.]"),
    ("LGPL-2.0", f"This library {FREE.format(';')} Library General Public License {LATER.format(';', '2')}"),
    ("LGPL-2.0", "This work is licensed under the GNU Library General Public License, version 2"),
    ("LGPL-2.1", f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 {VERBATIM} [This is the first "
                 "released version of the Lesser GPL. It also counts as the successor of the GNU Library Public "
                 "License, version 2, hence the version number 2.1.]"),
    ("LGPL-2.1", f"This library {FREE.format(';')} Lesser General Public License {LATER.format(';', '2.1')}"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {VERBATIM} This version of the GNU "
                 "Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General "
                 "Public License, supplemented by the additional permissions listed below."),
    ("LGPL-3.0", f"This library {FREE.format(':')} Lesser General Public License {LATER.format(',', '3')}"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 {VERBATIM} Preamble The GNU Affero "
                 "General Public License is a free, copyleft license for software and other kinds of works, "
                 "specifically designed to ensure cooperation with the community in the case of network server "
                 "software."),
    ("AGPL-3.0", f"This program {FREE.format(':')} Affero General Public License {LATER.format(',', '3')}"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
]
for version, day in (("1.1", "March 2000"), ("1.2", "November 2002"), ("1.3", "3 November 2008")):
    GNU += [
        (f"GFDL-{version}", f"GNU Free Documentation License Version {version}, {day} {VERBATIM} 0. PREAMBLE The "
                            "purpose of this License is to make a manual, textbook, or other functional and useful "
                            "document \"free\" in the sense of freedom"),
        (f"GFDL-{version}", "Permission is granted to copy, distribute and/or modify this document under the terms of "
                            f"the GNU Free Documentation License, Version {version} or any later version published "
                            "by the Free Software Foundation"),
    ]

CC = [
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or "
                "neighboring rights to this work"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES "
                "NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT "
                "RELATIONSHIP."),
    ("CC0-1.0", "Licensed under CC0 1.0"),
]
KINDS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
AREAS = {"3.0": "Unported", "4.0": "International"}
for kind, title in KINDS.items():
    for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        name = f"CC-{kind}-{version}"
        named = title if version == "4.0" else title.replace("NoDerivatives", "NoDerivs")
        whole = f"{named} {version} {AREAS.get(version, 'Generic')}"
        CC += [
            (name, f"Licensed under CC {kind} {version}"),
            (name, f"This work is licensed under a Creative Commons {whole} License"),
        ]
        if version == "4.0":
            CC.append((name, f"Creative Commons {whole} Public License By exercising the Licensed Rights (defined "
                             "below), You accept and agree to be bound by the terms and conditions of this Creative "
                             f"Commons {whole} Public License"))
        else:
            CC.append((name, f"Creative Commons Legal Code {whole.removesuffix(' Generic')} CREATIVE COMMONS CORPORATION "
                             "IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS LICENSE "
                             "DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP."))

OTHERS = [
    ("Apache-1.1", "The Apache Software License, Version 1.1"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a "
                   "copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under "
                   "the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF "
                   "ANY KIND, either express or implied."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR "
                   "USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and "
                   "conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this "
                   "document."),
    ("Artistic-1.0", "The intent of this document is to state the conditions under which a Package may be copied, "
                     "such that the Copyright Holder maintains some semblance of artistic control over the "
                     "development of the package"),
    ("Artistic-2.0", "This license establishes the terms under which a given free software Package may be copied, "
                     "modified, distributed, and/or redistributed."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met"),
    ("BSD", "Released under the BSD License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to "
                     "endorse or promote products derived from this software without specific prior written "
                     "permission."),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the "
                     "following acknowledgement"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
                "software and accompanying documentation covered by this license (the \"Software\") to use, "
                "reproduce, display, distribute, execute, and transmit the Software"),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution "
                 "License"),
    ("CDDL-1.0", "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0"),
    ("EPL-1.0", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License v1.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE "
                "PUBLIC LICENSE"),
    ("EUPL-1.1", "Licensed under the EUPL, Version 1.1"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2"),
    ("ISC", "Released under the ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all "
            "copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
             "hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\""),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files (the \"Software\"), to deal in the Software without "
            "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software"),
    ("MPL-1.0", "The contents of this file are subject to the Mozilla Public License Version 1.0"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1 1. Definitions. 1.0.1. \"Commercial Use\" means distribution or "
                "otherwise making the Covered Code available to a third party."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal "
                "entity that creates, contributes to the creation of, or owns Covered Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MS-PL", "This license governs use of the accompanying software. If you use the software, you accept this "
              "license. If you do not accept the license, do not use the software."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1"),
    ("PostgreSQL", "Permission to use, copy, modify, and distribute this software and its documentation for any "
                   "purpose, without fee, and without a written agreement is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
             "be held liable for any damages arising from the use of this software."),
    ("proprietary", "All rights reserved"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced"),
]

NOTICES = [*GNU, *CC, *OTHERS]
