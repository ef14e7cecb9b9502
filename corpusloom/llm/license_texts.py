"""Fixed values of the licence scan: notices and names by family, carrier phrases, and sentences that name no licence. Data only."""

from __future__ import annotations

#: Names and identifiers by family; each is put into the carrier phrases below.
NAMES = {
    "apache-2.0": (["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache 2 licence", "Apache Software License 2.0", "Apache License"], ["Apache-2.0"]),
    "mit": (["MIT License", "MIT license", "MIT licence", "MIT/X11 license", "Expat License", "MIT License (MIT)"], ["MIT"]),
    "gpl": (["GNU General Public License, version 3", "GNU General Public License v2", "GNU General Public License", "GPL v3", "GPLv3", "GPLv2", "GNU GPL", "GPL license"], ["GPL-3.0-or-later", "GPL-2.0-only", "GPL-3.0"]),
    "lgpl": (["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Library General Public License", "LGPL v3", "LGPLv2.1", "GNU LGPL"], ["LGPL-2.1-or-later", "LGPL-3.0"]),
    "agpl": (["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL v3", "AGPLv3", "GNU AGPL"], ["AGPL-3.0-or-later", "AGPL-3.0"]),
    "bsd": (["BSD 3-Clause License", "BSD 2-Clause License", "BSD license", "BSD-style license", "Simplified BSD License", "New BSD License", "3-clause BSD license"], ["BSD-3-Clause", "BSD-2-Clause"]),
    "isc": (["ISC License", "ISC licence", "Internet Systems Consortium license"], ["ISC"]),
    "mpl-2.0": (["Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"], ["MPL-2.0"]),
    "boost": (["Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License"], ["BSL-1.0"]),
    "epl": (["Eclipse Public License, Version 2.0", "Eclipse Public License v1.0", "Eclipse Public License"], ["EPL-2.0", "EPL-1.0"]),
    "eupl": (["European Union Public Licence, Version 1.2", "European Union Public Licence", "EUPL v1.2"], ["EUPL-1.2"]),
    "zlib": (["zlib License", "zlib/libpng license"], ["Zlib"]),
    "cc-by-nc": (["Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC-BY-NC license", "CC BY-NC-ND 4.0"], ["CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"]),
    "cc-by-sa": (["Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 4.0", "CC BY-SA 3.0 license"], ["CC-BY-SA-4.0"]),
    "cc-by": (["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 4.0", "CC BY 3.0 license"], ["CC-BY-4.0"]),
    "public-domain": (["CC0 1.0 Universal", "CC0 license", "Unlicense", "public domain dedication"], ["CC0-1.0", "Unlicense"]),
}

#: Carrier phrases; {} is a name, <> an identifier.
FRAMES = [
    "{}", "Licensed under the {}", "Released under the {}", "This work is licensed under the {}", "This project is licensed under the terms of the {}",
    "The code is available under the {}", "Distributed under the {}", "License: {}", "This program is distributed under the terms of the {}",
    "This software is released under the {}", "The source code is licensed under {}", "This file is part of a library made available under the {}", "Published under {}",
    "Licensed under {}", "Use of this source code is governed by a {} that can be found in the LICENSE file", "See the {} for more details",
    "The content of this site is licensed under a {}", "Code and data are provided under {}", "You may use this package under the {}", "All files are covered by the {}",
    "SPDX-License-Identifier: <>", "License: <>", "Licence :: <>", "\"license\": \"<>\"", "This package is licensed as <>", "license = <>",
]

#: Notices and paragraphs by family.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work",
        "You must give any other recipients of the Work or Derivative Works a copy of this License; and You must cause any modified files to carry prominent notices stating that You changed the files",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "The GNU Affero General Public License is a free, copyleft license for software, specifically designed to ensure cooperation with the community in the case of network server software.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES)",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    ],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "eupl": ["Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission, subsequent versions of the EUPL"],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    "cc-by-nc": ["You may not use the material for commercial purposes. This work is licensed under a Creative Commons Attribution-NonCommercial License"],
    "cc-by-sa": ["If you remix, transform, or build upon the material, you must distribute your contributions under the same Creative Commons Attribution-ShareAlike license as the original"],
    "cc-by": ["You must give appropriate credit, provide a link to the license, and indicate if changes were made. Creative Commons Attribution"],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.", "Released into the public domain", "This work is dedicated to the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
    ],
    "proprietary": [
        "All rights reserved", "Copyright 2020 the authors. All rights reserved.", "Copyright (c) 2019 Example Corp. All Rights Reserved", "No part of this publication may be reproduced without prior written permission",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.", "Proprietary and confidential. Do not distribute.",
        "Unauthorised use, copying or distribution is strictly prohibited", "The contents of this document are confidential and proprietary",
    ],
}

#: Sentences that name no licence, though many share words with one.
OTHERS = [
    "She renewed her driving license last week", "The restaurant lost its liquor license after the inspection", "A fishing license costs ten dollars a year",
    "He asked for permission to leave the room", "The museum gave permission to photograph the paintings", "Researchers at MIT built a small robot",
    "The Apache helicopter landed near the river", "The Apache people lived in the southwest", "Copyright law was debated in parliament",
    "The right of copyright was disputed for years", "Human rights groups met in the city", "The seats were reserved for guests", "All seats are reserved for members",
    "The gnu grazed on the open plain", "The public domain of the old king was a forest", "The warranty of the washing machine ran out", "Creative work is common in this town",
    "The court redistributed the land among the heirs", "Version 3 of the report came out in May", "The license plate was stolen", "Under the terms of the treaty the border moved",
    "Mozilla moved its office", "They license the brand to a maker of shoes", "The software was modified by the students", "The eclipse was seen by the public in many towns",
    "A boost in sales followed the release of version 2.0", "The European Union published a general report", "Students at the institute wrote the software in a year", "The general public was not admitted",
    "The authors are not liable in a court of law, he said", "A copy of the book was found in the library", "The library is free and open to the public", "Conditions in the camp were bad", "The following conditions were met by both sides",
    "This work took her many years", "The files were copied to another machine", "The document was published in source and translation", "The name of the holder was not given",
    "In no event did the visitors leave the bus", "The attribution of the painting is disputed", "Commercial use of the road began in spring", "The program was distributed in the hall before the concert", "You may not enter this room",
    "Use the back door after six", "He granted them a charge on the house", "Any person who saw the thief should call the police", "The foundation of the house is free of cracks", "The notice shall be read to all pupils",
]
