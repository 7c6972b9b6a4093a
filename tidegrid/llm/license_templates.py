"""Sentences that licence notices are made of, by family; fixed values from the public licence texts."""

TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004",
        "License: Apache-2.0",
        "Apache 2.0 license",
        "Licensed under Apache 2.0, see the LICENSE file.",
        "Available under the Apache License 2.0.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "License: MIT",
        "The MIT License (MIT)",
        "MIT licensed, see the LICENSE file.",
        "Available under the MIT license.",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "License: GPLv3",
        "GPLv3",
        "GPL-3.0",
        "Licensed under the GPL v3 or later.",
        "GNU General Public License Version 3, 29 June 2007",
        "Distributed under the terms of the GNU GPL version 3.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "License: LGPLv2.1",
        "LGPLv2.1",
        "LGPLv3",
        "GNU Lesser General Public License Version 2.1, February 1999",
        "Licensed under the GNU LGPL v3.",
    ),
    "agpl-3.0": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "License: AGPLv3",
        "AGPLv3",
        "AGPL-3.0",
        "GNU Affero General Public License Version 3, 19 November 2007",
        "Licensed under the GNU AGPL v3.",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "License: BSD",
        "3-clause BSD license",
        "Licensed under the 2-clause BSD license.",
        "BSD 2-Clause License",
        "BSD-3-Clause",
        "Available under the new BSD license.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "License: MPL-2.0",
        "MPL-2.0",
        "Mozilla Public License Version 2.0",
        "Licensed under the MPL 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under CC BY-NC-SA 4.0. Commercial use is not allowed.",
        "License: CC BY-NC 4.0",
        "CC-BY-NC-4.0",
        "Creative Commons Attribution-NonCommercial",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "License: CC BY 4.0",
        "CC-BY-4.0",
        "CC-BY-SA-4.0",
        "Licensed under a Creative Commons Attribution license.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply. CC BY-SA 4.0.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal.",
        "SPDX-License-Identifier: Unlicense",
        "License: CC0-1.0",
        "CC0-1.0",
        "This work has been dedicated to the public domain.",
        "Released into the public domain.",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced or distributed without prior written permission of the publisher.",
        "This software is confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "Proprietary and confidential.",
    ),
}
#: Notices of made-up licences, which belong to no family.
UNKNOWN: tuple[str, ...] = (
    "Licensed under the {name} License, version {n}.",
    "This work is licensed under the {name} Community License {n}.",
    "Released under the {name} Public Licence.",
    "Distributed under the terms of the {name} Software License Agreement.",
    "Use of this file is governed by the {name} license found in the repository.",
    "This package is available under the {name} Open Content License, v{n}.",
    "You may use this material only in accordance with the {name} terms of use.",
)
#: Sentences that speak of such things without being a notice.
NONE: tuple[str, ...] = (
    "You need a driving license to rent a car here.",
    "The museum is open to the public from nine to five.",
    "The software was released in the spring and is free of charge for students.",
    "He obtained a copy of the book and read it without a break.",
    "General conditions apply to all orders, see the last page of the catalogue.",
    "This version of the story is the work of a later author.",
    "The fishing license costs more than last year, the council said.",
    "Version 3 of the map shows the new roads and the public library.",
    "They agreed in writing to distribute the goods before the end of the year.",
    "Permission to build on the site was granted by the town last week.",
    "You may obtain a copy of the report at http://www.example.org/reports and at the town hall.",
    "You can obtain one at the counter or at http://example.org before the show.",
    "You should have received a copy of the invitation along with this letter.",
    "Permission is hereby granted to the club to use the hall free of charge.",
    "The above map and this note shall be included in all copies of the guide.",
    "Unless required by the court or agreed to in writing, the tenant pays at the end of the month.",
    "The goods are sold on an as is basis, without warranties of any kind.",
    "Redistribution of land and the use of water are governed by an old law.",
    "The following conditions are met by most schools in the county.",
    "The author has waived the fee for this reading to the extent possible.",
    "This novel is free of clichés and can be read by any person.",
    "Copying of this key is prohibited, ask the publisher of the paper.",
    "The file is found in the public library under the name of the general.",
    "Commercial use of the hall is not allowed on Sundays.",
    "The Apache helicopter and the Berkeley campus are shown on the cover.",
    "A student of the institute of technology wrote version 2.0 of the programme.",
)
