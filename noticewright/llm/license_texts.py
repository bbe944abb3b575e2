"""Wordings of public licences and of the notices that name them.

``<...>`` stands for any few words (a holder, a year). A licence may have several wordings.
"""

_WARRANTY = "is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."

TEMPLATES: list[tuple[str, str, str]] = [
    ("MIT", "text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The software " + _WARRANTY),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice-2", "Licensed under the MIT License."),
    ("ISC", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "notice", "Licensed under the ISC License."),
    ("BSD-2-Clause", "text", _BSD),
    ("BSD-3-Clause", "text", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."),
    ("Apache-2.0", "text", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "text", "This program " + _GNU.format("General Public License", "3")),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "text", "This program " + _GNU.format("General Public License", "2")),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "text", "This library " + _GNU.format("Lesser General Public License", "3")),
    ("AGPL-3.0", "text", "This program " + _GNU.format("Affero General Public License", "3")),
    ("MPL-2.0", "text", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", "notice", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "notice", "To the extent possible under law, <...> has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "short", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "short", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "short", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "short", "Licensed under CC BY-ND 4.0."),
    ("all-rights-reserved", "notice", "All rights reserved."),
]

#: Words of licences: a sentence that holds none is no part of a candidate block.
CUES = r"(?i)licen[cs]|copyright|all rights|spdx|permission|redistribut|public domain|warrant|liabilit|creative commons|free software|merchantab|mozilla|anyone is free|\bMPL\b"
