"""Standard license headers are accepted and told apart."""

import pytest

from spanloom.llm import licenses

GNU = (
    "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software "
    "Foundation, either version {} of the License, or (at your option) any later version."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
    'AUTHOR "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
BSD3 = BSD.replace(
    "THIS SOFTWARE IS", "3. Neither the name of the author nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. THIS SOFTWARE IS", 1,
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
    "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and "
    "by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
    "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment "
    "of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future "
    'rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
    "SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
    "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
    "this file, You can obtain one at https://mozilla.org/MPL/2.0/."
)


@pytest.mark.parametrize("text, label", [
    (GNU.format("", "3"), "gnu-gpl"), (GNU.format("Lesser ", "2.1"), "gnu-lgpl"), (GNU.format("Affero ", "3"), "gnu-agpl"),
    (BSD, "bsd-2-clause"), (BSD3, "bsd-3-clause"), (MPL, "mpl-2.0"), (UNLICENSE, "unlicense"),
])
def test_headers(text, label):
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES, licenses.LABELS)
    found = scanner.scan(text.encode())
    assert {x[2] for x in found.accepted} == {label} and max(x[1] for x in found.accepted) == found.n_words
    assert not scanner.scan(text.replace("GNU", "Other").replace("source", "some").replace("Source", "some").replace("free", "new").encode()).accepted


@pytest.mark.parametrize("text", [
    BSD.replace("IN NO EVENT SHALL THE AUTHOR BE", "THE AUTHOR SHALL BE"), BSD[: BSD.index("IN NO EVENT")],
    BSD3.replace("IN NO EVENT SHALL THE AUTHOR BE", "THE AUTHOR SHALL BE"), UNLICENSE.split(". ")[0] + ". Not really: all use is forbidden.",
    UNLICENSE.replace("WITHOUT WARRANTY", "WITH A WARRANTY"),
])
def test_altered_wording(text):
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES, licenses.LABELS)
    assert not scanner.scan(text.encode()).accepted
