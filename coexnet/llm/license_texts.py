"""Licence texts and notices as (SPDX id, text), fixed values.

Words in braces are the ones that tell a licence from its kin: they must stand in
a document as they stand here. The first braced phrase is where a search starts.
Notices that only differ in a name or a version are made by rule.
"""

from __future__ import annotations

_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, {merge, publish, distribute, sublicense}, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_BSD_OPEN = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions {in binary form must reproduce} the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to {endorse or promote} products derived from this software without specific prior written permission. "
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_GRANT = "Permission to {use, copy, modify, and/or distribute this software} for any purpose with or without fee is hereby granted"
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {%s} as published by the Free Software Foundation, {either version %s} of the License, or (at your option) any later version."
_GNU_ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of the {%s} as published by the Free Software Foundation, {version %s} of the License."
_GNU_NAMES = {"GPL": ("GNU General Public License", ("1", "2", "3")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3")), "AGPL": ("GNU Affero General Public License", ("3",))}
_LEADS = ("Released under the", "Licensed under the", "Distributed under the", "This work is licensed under the")

TEXTS: list[tuple[str, str]] = [
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_GRANT + ' The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", _BSD_OPEN + _BSD_TWO),
    ("BSD-2-Clause", _BSD_OPEN + _BSD_TWO + _BSD_END),
    ("BSD-3-Clause", _BSD_OPEN + _BSD_TWO + _BSD_THIRD),
    ("BSD-3-Clause", _BSD_OPEN + _BSD_TWO + _BSD_THIRD + _BSD_END),
    ("0BSD", _ISC_GRANT + ". " + _ISC_END),
    ("ISC", _ISC_GRANT + ", provided that the {above copyright notice and this permission notice appear} in all copies. " + _ISC_END),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software {must not be misrepresented}; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software {released into the public domain}. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and {accompanying documentation covered by this license} (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("Apache-2.0", 'Licensed under the {Apache License, Version 2.0} (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the {Mozilla Public License, v. 2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the {Eclipse Public License 2.0} which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC0-1.0", "To the extent possible under law, the author has {waived all copyright} and related or neighboring rights to this work."),
]
TEXTS += [(f"{k}-{v}{'' if '.' in v else '.0'}-or-later", _GNU % (name, v)) for k, (name, versions) in _GNU_NAMES.items() for v in versions]
TEXTS += [(f"{k}-{v}{'' if '.' in v else '.0'}", _GNU_ONLY % (name, v)) for k, (name, versions) in _GNU_NAMES.items() for v in versions]


def _notices():
    named = [("MIT", "{MIT License}"), ("ISC", "{ISC License}"), ("Unlicense", "{Unlicense}"), ("Zlib", "{zlib License}"), ("BSL-1.0", "{Boost Software License}, {Version 1.0}"), ("BSD", "{BSD License}")]
    named += [(f"BSD-{n}-Clause", "{BSD %d-Clause License}" % n) for n in (2, 3, 4)]
    named += [(f"Apache-{v}", "{Apache License, Version %s}" % v) for v in ("1.0", "1.1", "2.0")]
    named += [(f"MPL-{v}", "{Mozilla Public License, Version %s}" % v) for v in ("1.1", "2.0")]
    named += [(f"EPL-{v}", "{Eclipse Public License, Version %s}" % v) for v in ("1.0", "2.0")]
    named += [(f"{k}-{v}{'' if '.' in v else '.0'}", "{%s}, {version %s}" % (name, w)) for k, (name, versions) in _GNU_NAMES.items() for v in versions for w in ((v,) if "." in v else (v, f"{v}.0"))]
    for lead in _LEADS:
        yield from ((spdx, f"{lead} {name}") for spdx, name in named)
    versions = ("1.0", "2.0", "2.5", "3.0", "4.0")
    long = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
    for short, name in long.items():
        for v in versions:
            for form in ("CC %s %s" % (short, v), "CC-%s-%s" % (short, v)):
                yield f"CC-{short}-{v}", "Licensed under {%s}" % form
            yield f"CC-{short}-{v}", "This work is licensed under a {Creative Commons %s %s} International License" % (name, v)
    yield "CC0-1.0", "Licensed under {CC0 1.0}"


TEXTS += _notices()
