"""Pages written by hand, not by the generator that the model is fitted on, with their main text's blocks."""

NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav>'
FOOT = "<footer><p>&copy; 2024 The Daily. All rights reserved. <a href=/p>Privacy</a></p></footer>"
A = "The council met on Tuesday evening to talk about the new bridge over the river."
B = "Members could not agree on who should pay, and the vote was put off until next month."
C = "Nobody asked the people who live there."
SIDE = '<aside class="sidebar"><h3>Related</h3><ul><li><a href="/1">One more story</a></li><li><a href="/2">Another story</a></li></ul></aside>'
TALK = '<div class="comments"><div class="comment"><p>I was there and it was not like that at all, the mayor left early.</p></div><div class="comment"><p>Thanks!</p></div></div>'

PAGES = [
    (f"<body>{NAV}<div><div><h1>Bridge</h1><p>{A}</p><p>{B}</p></div></div>{FOOT}</body>", ["Bridge", A, B]),
    (f"<html><head><title>x</title></head><body>{NAV}<div><h1>Bridge</h1><p>{A}</p></div>{FOOT}</body></html>", ["Bridge", A]),
    (f"<body><div>{NAV}<div><div><p>{A}</p><p>{B}</p><p>{C}</p></div></div>{FOOT}</div></body>", [A, B, C]),
    (f"<body>{NAV}<div><div><div><p>{A}</p></div></div></div>{FOOT}</body>", [A]),
    (f"<body>{NAV}<article><h1>Reading list</h1><p>{A}</p><ul><li><a href=/a>A history of bridges</a></li><li><a href=/b>Rivers and towns</a></li><li><a href=/c>How councils vote</a></li></ul></article>{FOOT}</body>", ["Reading list", A, "A history of bridges", "Rivers and towns", "How councils vote"]),
    (f"<body>{NAV}<main><h1>Sources</h1><p>{A}</p><p>{B}</p><ol><li><a href=/a>Minutes of the council</a> 2023</li><li><a href=/b>The report on the bridge</a> 2021</li></ol></main>{FOOT}</body>", ["Sources", A, B, "Minutes of the council 2023", "The report on the bridge 2021"]),
    (f"<body>{NAV}<article><h2>Short</h2><p>{C}</p>{TALK}</article>{FOOT}</body>", ["Short", C]),
    (f"<body>{NAV}<article><p>{C}</p>{TALK}</article></body>", [C]),
    (f"<body>{NAV}<main><article><h1>Bridge</h1><p>{A}</p>{SIDE}<p>{B}</p></article></main>{FOOT}</body>", ["Bridge", A, B]),
    (f"<body><div class=page>{NAV}<div class=content><h1>Bridge</h1><p>{A}</p><p>{B}</p>{TALK}</div>{SIDE}{FOOT}</div></body>", ["Bridge", A, B]),
    (f"<body>{NAV}<div id=main><div class=post><h1>Bridge</h1><p>{A}</p><blockquote>{C}</blockquote><p>{B}</p></div></div>{FOOT}</body>", ["Bridge", A, C, B]),
    (f"<body><header><h1>The Daily</h1></header>{NAV}<article><h1>Bridge</h1><p>{A}</p><table><tr><td>Cost</td><td>Nine</td></tr></table></article>{FOOT}</body>", ["Bridge", A, "Cost", "Nine"]),
    (f"<body><div class=cookie-banner><p>We use cookies. <a href=/c>More</a></p></div>{NAV}<div><div><h1>Bridge</h1><p>{A}</p><p>{B}</p></div></div>{FOOT}</body>", ["Bridge", A, B]),
    (f"<body>{NAV}<section><h1>Bridge</h1><p>{A}</p><p>{B}</p></section>{SIDE}{FOOT}</body>", ["Bridge", A, B]),
    (f"<body>{NAV}<div><h1>Bridge</h1><p>{A}</p><div class=advertisement><p>Buy a boat today</p></div><p>{B}</p></div>{FOOT}</body>", ["Bridge", A, B]),
    (f"<body>{NAV}<div><p>{A}</p><form><label>Your mail</label><input><button>Go</button></form><p>{B}</p></div>{FOOT}</body>", [A, B]),
    (f"<body><p>{A}</p><p>{B}</p></body>", [A, B]),
    (f"<body>{NAV}<p>{A}</p><p>{B}</p>{FOOT}</body>", [A, B]),
    (f"<body>{NAV}<h1>Bridge</h1><p>{A}</p>{SIDE}{FOOT}</body>", ["Bridge", A]),
    (f"<body>{NAV}<article><h1>Bridge</h1><p>{A} <a href=/m>{B}</a></p></article>{FOOT}</body>", ["Bridge", f"{A} {B}"]),
    (f"<body><div><div>{NAV}</div><div><div><h1>Bridge</h1><div><p>{A}</p><p>{B}</p></div></div></div><div>{FOOT}</div></div></body>", ["Bridge", A, B]),
    (f"<body>{NAV}<article><h1>Bridge</h1><ul><li>{A}</li><li>{B}</li></ul></article>{TALK}{FOOT}</body>", ["Bridge", A, B]),
    (f"<body>{NAV}<main><div><h1>Bridge</h1><p>{A}</p></div></main>{SIDE}</body>", ["Bridge", A]),
    (f"<body>{NAV}<article><header><h1>Bridge</h1></header><p>{A}</p><p>{B}</p></article>{FOOT}</body>", ["Bridge", A, B]),
    (f"<body>{NAV}<article><h1>Bridge</h1><dl><dt>Length</dt><dd>{C}</dd></dl><p>{A}</p></article>{FOOT}</body>", ["Bridge", "Length", C, A]),
    (f"<body>{NAV}<div><h1>Bridge</h1><p>{A}</p><ul><li><a href=/a>A history of bridges</a></li><li><a href=/b>Rivers and towns</a></li></ul><p>{B}</p></div>{FOOT}</body>", ["Bridge", A, "A history of bridges", "Rivers and towns", B]),
    (f"<body>{NAV}<div><div><p>{A}</p><p>{B}</p></div>{TALK}</div>{FOOT}</body>", [A, B]),
    (f"<body>{NAV}<article><h1>Bridge</h1><p>{A}</p><h2>See also</h2><ul><li><a href=/a>Rivers</a></li></ul></article>{FOOT}</body>", ["Bridge", A, "See also", "Rivers"]),
    (f"<body><header><a href=/>The Daily</a></header>{NAV}<div class=wrapper><div><h1>Bridge</h1><p>{A}</p><p>{B}</p><p>{C}</p></div></div>{FOOT}</body>", ["Bridge", A, B, C]),
    (f"<body>{NAV}<div><h1>Bridge</h1><p>{A}</p><pre>x = 1</pre><p>{B}</p></div>{FOOT}</body>", ["Bridge", A, "x = 1", B]),
]
#: Places of those that aren't right yet: lists of nothing but links within an article (dropped as menus are), and one long paragraph
#: alone in three divs without a name.
OPEN = {3, 4, 5, 25, 27}
