"""Licence notices that scans look for: label to the texts that stand for it, in the licences' own words.

The notices are fixed values. They are the short forms that files carry; further ones are given to
the scan as a parameter of the same shape.
"""

from __future__ import annotations

#: Phrases that give a label wherever their words stand consecutively.
PHRASES = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}

_WARRANTY = (
    "without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. "
    "See the GNU {0} for more details."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as "
    "published by the Free Software Foundation, either version {1} of the License, or (at your option) any later "
    "version. This program is distributed in the hope that it will be useful, but " + _WARRANTY
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution."
)
_BSD_NAME = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_CC = "This work is licensed under a Creative Commons {} {} International License."
_CC_KINDS = {
    "cc-by-4.0": ("Attribution", "CC BY"),
    "cc-by-sa-4.0": ("Attribution-ShareAlike", "CC BY-SA"),
    "cc-by-nc-4.0": ("Attribution-NonCommercial", "CC BY-NC"),
    "cc-by-nd-4.0": ("Attribution-NoDerivatives", "CC BY-ND"),
    "cc-by-nc-sa-4.0": ("Attribution-NonCommercial-ShareAlike", "CC BY-NC-SA"),
    "cc-by-nc-nd-4.0": ("Attribution-NonCommercial-NoDerivatives", "CC BY-NC-ND"),
}

NOTICES: dict[str, list[str]] = {
    "agpl-3.0": [_GNU.format("Affero General Public License", "3")],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License.",
    ],
    "bsd-2-clause": [_BSD_HEAD],
    "bsd-3-clause": [f"{_BSD_HEAD} {_BSD_NAME}"],
    "bsl-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, '
        "execute, and transmit the Software, and to prepare derivative works of the Software"],
    "cc0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this "
        "work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal."],
    "gpl-2.0": [_GNU.format("General Public License", "2"),
                "This work is licensed under the GNU General Public License, version 2"],
    "gpl-3.0": [_GNU.format("General Public License", "3"),
                "This work is licensed under the GNU General Public License, version 3"],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl-3.0": [_GNU.format("Lesser General Public License", "3")],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ofl-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."],
    "zlib": [
        'This software is provided "as-is", without any express or implied warranty. In no event will the authors be held '
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
    **{label: [_CC.format(kind, "4.0"), f"Licensed under {short} 4.0"] for label, (kind, short) in _CC_KINDS.items()},
}
