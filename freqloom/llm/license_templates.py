"""Wordings by which texts state or carry a license: paragraphs of licenses, file headers and short notices.

Fixed values, written from the licenses' public wordings. Each has at least five words and no apostrophe.
"""

from __future__ import annotations

GPL_GRANT = "This {work} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{version}"
GPL_WARRANTY = "This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
GPL_COPY = "You should have received a copy of the GNU {name} along with this {work}"
LATER = "{0} either version {1} of the License, or (at your option) any later version."

# Paragraphs and headers of 17 words and more.
PARAGRAPHS = {
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-names": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-4-Clause-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-header": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "ISC-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0BSD-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "ISC-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-header-end": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-contributed": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
    "Apache-2.0-definitions": "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    "Apache-2.0-copyright": "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "Apache-2.0-patent": "Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work,",
    "Apache-2.0-redistribution": "Redistribution. You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions:",
    "Apache-2.0-warranty": "Disclaimer of Warranty. Unless required by applicable law or agreed to in writing, Licensor provides the Work (and each Contributor provides its Contributions) on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied,",
    "GPL-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "GPL-3.0-preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
    "GPL-2.0-preamble": "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "LGPL-2.1-preamble": "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This license, the Lesser General Public License, applies to some specially designated software packages",
    "LGPL-3.0-preamble": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "AGPL-3.0-preamble": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "GPL-2.0-header": GPL_GRANT.format(work="program", mark=";", name="General Public License", version=LATER.format(";", "2")),
    "GPL-2.0-only-header": GPL_GRANT.format(work="program", mark=";", name="General Public License", version="; version 2 of the License only."),
    "GPL-2.0-version-2-header": GPL_GRANT.format(work="program", mark=";", name="General Public License version 2", version="."),
    "GPL-3.0-header": GPL_GRANT.format(work="program", mark=":", name="General Public License", version=LATER.format(",", "3")),
    "LGPL-2.1-header": GPL_GRANT.format(work="library", mark=";", name="Lesser General Public License", version=LATER.format(";", "2.1")),
    "LGPL-3.0-header": GPL_GRANT.format(work="program", mark=":", name="Lesser General Public License", version=LATER.format(",", "3")),
    "AGPL-3.0-header": GPL_GRANT.format(work="program", mark=":", name="Affero General Public License", version=LATER.format(",", "3")),
    "GPL-warranty": GPL_WARRANTY.format(work="program", name="General Public License"),
    "LGPL-warranty": GPL_WARRANTY.format(work="library", name="Lesser General Public License"),
    "AGPL-warranty": GPL_WARRANTY.format(work="program", name="Affero General Public License"),
    "GPL-2.0-copy": GPL_COPY.format(work="program;", name="General Public License") + " if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "GPL-3.0-copy": GPL_COPY.format(work="program.", name="General Public License") + " If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-2.1-copy": GPL_COPY.format(work="library;", name="Lesser General Public License") + " if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "LGPL-3.0-copy": GPL_COPY.format(work="program.", name="Lesser General Public License") + " If not, see <https://www.gnu.org/licenses/>.",
    "AGPL-3.0-copy": GPL_COPY.format(work="program.", name="Affero General Public License") + " If not, see <https://www.gnu.org/licenses/>.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MPL-2.0-secondary": "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
    "MPL-2.0-grant": "Each Contributor hereby grants You a world-wide, royalty-free, non-exclusive license: under intellectual property rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit its Contributions,",
    "MPL-1.1-header": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
    "CC-exercise": "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons",
    "CC-grant": "Subject to the terms and conditions of this Public License, the Licensor hereby grants You a worldwide, royalty-free, non-sublicensable, non-exclusive, irrevocable license to exercise the Licensed Rights in the Licensed Material to:",
    "CC-unported-grant": "Subject to the terms and conditions of this License, Licensor hereby grants You a worldwide, royalty-free, non-exclusive, perpetual (for the duration of the applicable copyright) license to exercise the rights in the Work as stated below:",
    "CC-unported-opening": "THE WORK (AS DEFINED BELOW) IS PROVIDED UNDER THE TERMS OF THIS CREATIVE COMMONS PUBLIC LICENSE (\"CCPL\" OR \"LICENSE\"). THE WORK IS PROTECTED BY COPYRIGHT AND/OR OTHER APPLICABLE LAW.",
    "CC-visit": "To view a copy of this license, visit http://creativecommons.org/licenses/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
    "CC0-1.0-waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC0-1.0-dedication": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
}

# Names of licenses in short notices.
NAMES = {
    "MIT": ["MIT License"],
    "BSD": ["BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "ISC": ["ISC License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL": ["GNU General Public License", "GNU GPL"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GNU GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GNU GPL v3"],
    "LGPL": ["GNU Lesser General Public License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"],
    "AGPL": ["GNU Affero General Public License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0 license"],
    "CC0-1.0": ["CC0 1.0 Universal license"],
}
PARTS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
VERBS = ["Licensed", "Released", "Distributed", "Available"]
ENDS = ["", ".", ","]


def ended(heads: list[str]) -> list[str]:
    """At most seven words have three shingles, of which a share of 0.75 needs all: so no version passes for another, and
    each mark that may follow is a wording of its own."""
    return [h + end for h in dict.fromkeys(" ".join(h.split()[-7:]) for h in heads) for end in ENDS]


def named(name: str) -> list[str]:
    """Notices that name a license, with a verb before it if they have too few words without."""
    bare = f"under the {name}"
    return ended([*([bare] if len(bare.split()) >= 5 else [f"{v} {bare}" for v in VERBS]), f"terms of the {name}"])


def short_notices() -> dict[str, str]:
    found = {key: [w for name in names for w in named(name)] for key, names in NAMES.items()}
    found["CC0-1.0"] += ended(["under Creative Commons CC0 1.0", "Licensed under CC0 1.0 Universal"])
    for code, parts in PARTS.items():
        brief = f"CC {code} 4.0"
        found[f"CC-{code}-4.0"] = [*ended([f"Licensed under {brief}", f"Released under {brief}"]), f"under a {brief}", f"under the {brief}"]
        for version, scope in (("4.0", "International"), ("3.0", "Unported")):
            found.setdefault(f"CC-{code}-{version}", []).extend(ended([f"Creative Commons {parts} {version} {scope}", f"Creative Commons {parts} {version} License"]))
    return {f"{key}-notice-{i}": text for key, texts in found.items() for i, text in enumerate(texts, 1)}
