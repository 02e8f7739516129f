"""Whole texts of short licences, digests of long ones, titles, one-line notices."""

from __future__ import annotations

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

"""
_ZERO = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

"""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <"""
#: Licence id, whole text, and the titles under which it is found.
_WHOLE = (
    ("MIT", _MIT, ("MIT License", "The MIT License (MIT)", "The MIT License")),
    ("ISC", _ISC + _AS_IS, ("ISC License", "The ISC License", "ISC License (ISC)")),
    ("0BSD", _ZERO + _AS_IS, ("Zero-Clause BSD", "BSD Zero Clause License")),
    ("Zlib", _ZLIB, ("zlib License", "The zlib License")),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS, ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License")),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_AS_IS, ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License")),
    ("BSL-1.0", _BOOST, ("Boost Software License - Version 1.0 - August 17th, 2003",)),
    ("Unlicense", _UNLICENSE + "http://unlicense.org/>", ()), ("Unlicense", _UNLICENSE + "https://unlicense.org>", ()), ("Unlicense", _UNLICENSE + "https://unlicense.org/>", ()),
)
#: One-line notices.
_NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("ISC", "SPDX-License-Identifier: ISC"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-only"), ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"), ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"), ("Unlicense", "SPDX-License-Identifier: Unlicense"), ("BSL-1.0", "SPDX-License-Identifier: BSL-1.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)
#: Known texts as (license id, text).
KNOWN = tuple((name, text) for name, whole, titles in _WHOLE for text in (whole, *(f"{t}\n\n{whole}" for t in titles))) + _NOTICES
#: Long licences as (license id, digest of the canonical form of the whole text, by `licenses.digest`),
#: with and without the appendix or exhibits where there are some.
KNOWN_DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "1417d69346fcbd23dc902ca6fc3ab26d33252ef1696d4cd7c6f0fef0abd3226d"),
    ("Apache-2.0", "258062093eca6de5cb6dbdb244b46797dd65dcf8a1d9e44086c33d9dbbad99dc"),
    ("Apache-2.0", "8fa9b403a0dc3fae5643d85ddaec9c32e73e87552efacba7f3c69bc75276edc1"),
    ("Artistic-1.0-Perl", "4834e699353522cfb463bd8b374752ecf02156bb3f5dfb53d0edb502a112a651"),
    ("CC0-1.0", "38ef173883793b023a74895ce0af4bbdeb6bb0bc904463871c507b03695c9c81"),
    ("GFDL-1.2", "40b89fe20169298a8589aaf56792baba234d474e5dbea63e948c226e4a4e66c3"),
    ("GFDL-1.3", "62daa9e1fa3f355de21c3bc8212c1e55cc97e7665004caeb491037b60cce511d"),
    ("GPL-1.0", "0653ff6448e1186e0276d34152b97a470e40d381bb9aae8c8931c5c4eeaae37a"),
    ("GPL-2.0", "05ea7e4114b3f7aec5c7dd58fc1fd321cbdcf66a72a5a3e9f677618f0f6f05e0"),
    ("GPL-2.0", "48aa1cc09278c990143598f5c37c848606b728a4babb43c5f55e16bc66206c59"),
    ("GPL-3.0", "50861e8ddaa22b0a4e33b4d32b1e75a2a9d9949b5074bb0c40f927db93cdd7b0"),
    ("GPL-3.0", "a246e5e81217118e5032b10c0e0d3e9ff2c56c9a513c9d0200d5d7d397d494c2"),
    ("LGPL-2.0", "2a6ac921e4c62568a2b266e6164cb6819d2a06f7007ad9e187ada8d4770702d2"),
    ("LGPL-2.1", "0ca5c17aaa8deceea63b6afae195c7b8e4c2457d104e2a35bb62009f9d4d603b"),
    ("LGPL-2.1", "6ad660ce7213b3936d685c9ada84361135e273f79189cf0cd0a298e16764def8"),
    ("LGPL-3.0", "6a1e21cb1f0adda77c68071a8eeadb804a92ffdcaa150c17f976711652333fa0"),
    ("MPL-1.1", "e15720e0b148bbd07286a99c001a95471fae41dd3a1c642aa01df4893417b787"),
    ("MPL-2.0", "16bf53094aa71cdf0e28cf166f759a4fde1cc1e3cae6c443ef8e6bf4157561f4"),
    ("MPL-2.0", "e52a3149c7976fdb64748aa7b95fb7e6462b42300129c03595db904f7214b54c"),
)
