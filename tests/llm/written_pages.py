"""Pages written by hand, from no generator and with no page of the given tables in them. {{...}} marks each block of the main
text; the rest is furniture. FIRST were looked at while the labeller was worked on; LAST were only ever counted."""

import html
import re


def page_and_text(written: str) -> tuple[str, str]:
    """The page without the marks, and its main text."""
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.findall(r"\{\{(.*?)\}\}", written, re.S)]
    return written.replace("{{", "").replace("}}", ""), "\n".join(blocks)


FIRST = [
    """<html><body><div id="nav"><a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a></div>
    <div class="story"><h1>{{Bridge to close for repairs}}</h1><p>{{The old bridge over the river will close in April, the council said on Monday.}}</p>
    <p>{{Engineers found rust in eleven of the forty bearings and want to replace all of them at once.}}</p><p>{{Drivers will have to use the ring road until the autumn.}}</p></div>
    <div id="foot">Copyright 2020 Town Herald</div></body></html>""",
    """<html><head><title>Soup</title></head><body><div class="wrap"><div class="brand">Kitchen Notes</div><div class="post"><h2>{{Leek soup for cold evenings}}</h2>
    <p>{{Wash the leeks well, since sand hides between the leaves, and cut them into thin rings.}}</p><p>{{Let them sweat in butter for a quarter of an hour without taking colour.}}</p></div>
    <div id="disqus_thread"><div class="post"><p>Made this twice, my children loved it!</p></div><div class="post"><p>Too much salt for me.</p></div></div></div>&copy; Kitchen Notes</body></html>""",
    """<body><table><tr><td><a href="a">Start</a><br><a href="b">Photos</a><br><a href="c">Guestbook</a></td><td><h1>{{Our trip to the islands}}</h1>
    <p>{{We left at five in the morning, and the ferry was already full of hikers and bicycles.}}<p>{{On the second island there is no road at all, only a path of white gravel along the cliffs.}}
    <p>{{In the evening we sat on the pier and counted the lights of the fishing boats.}}</td></tr></table><center>Last updated 3 May 2004 | webmaster@example.org</center></body>""",
    """<body><div><a href="/">Home</a> | <a href="/about">About</a> | <a href="/contact">Contact</a></div><div><h1>{{Why clocks drift}}</h1>
    <p>{{A quartz crystal changes its pitch a little with temperature, and so every clock gains or loses some seconds a month.}}</p>
    <h2>{{Keeping them right}}</h2><p>{{Radio signals from a few transmitters carry the time of atomic clocks, and cheap receivers listen to them at night.}}</p></div>
    <div><p>Terms of use</p><p>Privacy policy</p></div></body>""",
    """<body><div class="masthead"><h2>Valley Gazette</h2></div><div class="breadcrumbs"><a href="/">Home</a> &raquo; <a href="/f">Farming</a></div><section class="text">
    <h1>{{Apples are late this year}}</h1><p>{{A frost in the first week of May took half of the blossom in the lower orchards.}}</p><div class="share"><a href="#">Tweet</a> <a href="#">Mail</a></div>
    <p>{{Growers further up were luckier, but there the fruit needs two more weeks of sun.}}</p></section><div class="rail"><h3>Most read</h3><ul><li><a href="/1">Mayor resigns</a></li><li><a href="/2">Pool opens</a></li></ul></div>
    <div class="bottom">All rights reserved</div></body>""",
    """<body><div class="gdpr">We and our partners use cookies. <button>Accept</button></div><div class="entry"><h1>{{Learning to whittle}}</h1><p>{{Start with lime wood, which is soft and has hardly any grain.}}</p>
    <ul><li>{{A short fixed blade}}</li><li>{{A strop and some polish}}</li><li>{{Plasters}}</li></ul><p>{{Always cut away from your thumb, and stop when your hands get tired.}}</p></div>
    <div class="replies"><h3>2 replies</h3><p>Thanks, this was just what I needed.</p><p>Basswood is the same thing, by the way.</p></div><form><input name=q><label>Your reply</label><button>Send</button></form></body>""",
    """<body><span><a href=/>The Daily Fern</a></span><main><h1>{{Moss on the north side}}</h1><p>{{It is an old saying that moss shows the way north, and it is mostly wrong.}}</p>
    <blockquote>{{I have seen it on every side of a trunk, wrote the forester in his diary.}}</blockquote><p>{{What moss wants is shade and damp, and both can be had anywhere in a dense wood.}}</p></main><span>Imprint</span></body>""",
    """<body><div class="x1 y7"><a href="/a">Shop</a><a href="/b">Help</a><a href="/c">Cart (0)</a></div><div class="k3"><div class="q9"><h1>{{How to store cheese}}</h1>
    <p>{{Hard cheese keeps for weeks when it is wrapped in paper and lies in the warmest part of the fridge.}}</p><p>{{Plastic foil makes it sweat, and after some days it tastes of the foil.}}</p></div></div>
    <div class="z2"><p>Subscribe to our newsletter</p><p>&copy; 2022 The Cheese Shop Ltd.</p></div></body>""",
    """<body><header><h1>City Library</h1></header><nav><a href="#">Catalogue</a></nav><article><h2>{{New reading room opens}}</h2><p>{{After two years of work the reading room on the third floor is open again.}}</p>
    <p>{{There are sixty seats, half of them by the windows, and lockers for bags and coats.}}</p></article><footer><p>Opening hours: Mon-Fri 9-18</p></footer></body>""",
    """<body><div role="banner">Night Sky Weekly</div><div role="main"><h1>{{Two comets in one month}}</h1><p>{{The first can be seen low in the west after sunset, though only with binoculars.}}</p>
    <p>{{The second will be brighter, and may reach the third magnitude around the twentieth.}}</p></div><div role="complementary"><p>Advertisement</p><p>Telescopes from 99 euros</p></div></body>""",
    """<body><ul class="topnav"><li><a href="/">Front page</a><li><a href="/w">World</a><li><a href="/l">Local</a></ul><div class="body-copy"><h1>{{Storm damages harbour wall}}</h1>
    <p>{{Waves of more than six metres broke over the harbour wall on Tuesday night.}}<p>{{Nobody was hurt, but four boats sank at their moorings and the lighthouse lost its power.}}
    <p>{{Repairs will take until the summer, the harbour master told reporters.}}</div><div class="site-footer">&copy; 2019 Coast Journal. All rights reserved.</div></body>""",
    """<body><div id="top">Grandma's Recipes</div><div id="menu"><a href="1">Cakes</a> <a href="2">Soups</a> <a href="3">Breads</a></div><div id="recipe"><h1>{{Plain rye bread}}</h1><p>{{Mix the flour with the sour dough and leave it in a warm place overnight.}}</p>
    <ol><li>{{Knead the dough for ten minutes.}}</li><li>{{Let it rise for two hours.}}</li><li>{{Bake it for fifty minutes in a hot oven.}}</li></ol><p>{{The bread is best on the second day, when the crust has become a little softer.}}</p></div>
    <div id="newsletter"><p>Get recipes by mail</p><input><button>Sign up</button></div></body>""",
    """<body><div><p><a href="/">Back to overview</a></p></div><div><h1>{{Notes on old maps}}</h1><p>{{Before triangulation a map was drawn from the reports of travellers, and coasts were often wrong by a day's sail.}}</p>
    <p>{{Mountains were shown from the side, like molehills, and nobody could tell how high they were.}}</p><p>{{The first sheets with contour lines appeared late in the eighteenth century.}}</p></div><div>Powered by a small server</div></body>""",
    """<body><div class="alert">Scheduled maintenance on Sunday night.</div><div class="hero"><h2>Mountain Club</h2></div><div class="single"><h1>{{Hut closed until June}}</h1>
    <p>{{An avalanche has torn away the water pipe of the upper hut, and it can't be repaired before the snow melts.}}</p><p>{{The winter room stays open, but hikers have to bring their own water and wood.}}</p></div>
    <div class="tags"><a href="/t/huts">huts</a> <a href="/t/snow">snow</a></div><div class="pager"><a href="/p">Older</a> <a href="/n">Newer</a></div></body>""",
    """<body><article><h1>{{A bell is cast}}</h1><p>{{The mould had dried for nine weeks when the bronze was poured, and it took only four minutes.}}</p><aside><p>Also read: Organs of the region</p></aside>
    <p>{{Three days later it was dug out, still warm, and struck for the first time.}}</p><section id="respond"><h3>Leave a reply</h3><p>Your email will not be published.</p></section></article></body>""",
    """<body><font><a href=i.html>Index</a> - <a href=l.html>Links</a></font><hr><h1>{{Repairing a bicycle hub}}</h1><p>{{Loosen the cone nut with two flat spanners and take the axle out over a dish, so that no ball gets lost.}}
    <p>{{Clean everything with petrol and look at the races under a good lamp.}}<p>{{Pack the balls in fresh grease and turn the cone until the play has just gone.}}<hr><font>Mail comments to the author</font></body>""",
    """<body><div class="l-head"><a href="/">Science Review</a></div><div class="l-main"><div class="c-article"><h1>{{Bees see in the dark}}</h1><div class="c-article__text"><p>{{Tropical bees that fly at night find their nests with the light of the stars alone.}}</p>
    <p>{{Their eyes add up the light of several facets, at the price of a coarser image.}}</p></div></div><div class="c-related"><p><a href="/1">Ants count their steps</a></p><p><a href="/2">Moths and street lamps</a></p></div></div>
    <div class="l-foot"><p>About us</p><p>Jobs</p></div></body>""",
    """<body><div class="cookiebar"><p>This site uses cookies.</p><a href="#">OK</a></div><main><section><h2>{{Winter timetable}}</h2><p>{{From the second Sunday in December trains to the coast leave at ten past the hour.}}</p>
    <table><tr><td>{{Departure of the first train}}</td><td>{{4:10}}</td></tr></table><p>{{Night trains run only on Fridays and Saturdays, as in the years before.}}</p></section></main><footer>Contact | Imprint</footer></body>""",
    """<body><div class="navbar"><a href=/>Start</a><a href=/blog>Blog</a></div><div class="blogpost"><h1>{{My year without a car}}</h1><p>{{I sold it in January, mostly because the repairs had become dearer than the car.}}</p>
    <p>{{The first weeks were hard, as every errand had to be planned around the bus.}}</p><p>{{By summer I had a cargo bicycle, and now I would not go back.}}</p></div>
    <ol class="commentlist"><li>Good for you! I could never do that.</li><li>What about the winter?</li></ol><div class="credits">Theme by Someone</div></body>""",
    """<body><div class="ads">Cheap flights from 19 euros!</div><div class="text"><p>{{The museum has bought a letter that was thought to be lost for a hundred years.}}</p><p>{{It was found in the binding of a prayer book, folded eight times.}}</p>
    <p>{{From March on it will be shown together with the answer, which the archive has always had.}}</p></div><div class="ads">Hotels near you</div></body>""",
    """<body><form class="login"><label>User</label><input><label>Password</label><input><button>Log in</button></form><h1>{{Rules of the allotment}}</h1><p>{{Every member keeps the path in front of the garden free of weeds.}}</p>
    <p>{{Fires are allowed from October to March, when the wind blows away from the houses.}}</p><div class="legal">No liability is accepted.</div></body>""",
    """<body><div id="page"><div id="hd"><h1>Radio Amateur</h1></div><div id="bd"><div class="story-text"><h2>{{An aerial from two poles}}</h2><p>{{Two fishing rods and ten metres of wire are enough for the forty metre band.}}</p>
    <p>{{Set the feed point as high as you can, and let the ends slope down towards the ground.}}</p></div><div class="sidebar-right"><h4>Categories</h4><p>Aerials (12)</p><p>Receivers (7)</p></div></div><div id="ft"><p>Site map</p></div></div></body>""",
    """<body><nav>Home News</nav><div class="content"><h1>{{Das Hochwasser geht zur&uuml;ck}}</h1><p>{{Seit dem Morgen f&auml;llt der Pegel, doch die Keller in der Altstadt stehen noch immer unter Wasser.}}</p><p>{{Die Feuerwehr rechnet damit, dass das Pumpen bis zum Wochenende dauert.}}</p></div>
    <div class="werbung anzeige"><p>Anzeige</p></div><footer>Impressum &middot; Datenschutz</footer></body>""",
    """<body><div class="header">La Gaceta</div><div class="post-body"><h1>{{Vuelve el tren de la costa}}</h1><p>{{Despu&eacute;s de doce a&ntilde;os el tren volver&aacute; a circular entre los pueblos de la costa a partir de junio.}}</p>
    <p>{{Los vecinos lo piden desde que se cerr&oacute; la l&iacute;nea por falta de viajeros.}}</p></div><div class="comentarios comments"><p>&iexcl;Por fin!</p></div></body>""",
    """<body><main><h1>{{Sharpening a plane}}</h1><p>{{Flatten the back of the iron first, since two planes have to meet for an edge.}}</p><p class="promo">Special offer: whetstones, 20 % off</p><p>{{Then hold the bevel at twenty-five degrees and draw it towards you.}}</p></main></body>""",
    """<body><div class="outer"><div class="inner"><a href="/">Weather Blog</a></div></div><div class="outer"><div class="inner"><h1>{{Why fog lies in valleys}}</h1><p>{{Cold air is heavier than warm air and flows downhill on clear nights like water.}}</p>
    <p>{{In the basin it cools further, until the moisture in it can no longer stay a vapour.}}</p></div></div><div class="outer"><div class="inner">Copyright Weather Blog 2021</div></div></body>""",
    """<body><menu><li>File</li><li>Edit</li></menu><article><p>{{The choir was founded by eleven miners who met in the back room of an inn.}}</p><p>{{A hundred years later it has ninety members, and not one of them has been in a mine.}}</p></article><dialog><p>Please rate this page</p></dialog></body>""",
    """<body><div class="site-title">Old Engines</div><div class="article-wrap"><h1>{{Starting the big diesel}}</h1><p>{{It takes three people and half an hour to start the engine, and more when it is cold.}}</p><figure><figcaption>{{The flywheel weighs eight tonnes.}}</figcaption></figure>
    <p>{{Compressed air turns it over twice, and then the first cylinder fires with a crack.}}</p></div><div class="social"><a href=#>Follow us</a></div></body>""",
    """<body><div class="warning">Your browser is out of date.</div><div class="page-content"><h1>{{Counting swifts}}</h1><p>{{Volunteers count the swifts at forty towers on the same evening in July.}}</p><p>{{The numbers have fallen by a third since the count began.}}</p></div>
    <div class="discussion"><h3>Discussion</h3><div class="msg"><p>We still have six pairs in our street.</p></div><div class="msg"><p>New roofs leave no gaps for them.</p></div></div></body>""",
    """<body><div>Home / Guides / Garden</div><div><h1>{{Pruning roses}}</h1><p>{{Wait until the forsythia blooms, and then cut back to three or five buds.}}</p><p>{{The cut should slope away from the bud, so that rain runs off.}}</p></div><div><a href=/>Guides</a> <a href=/>Shop</a> <a href=/>Contact</a></div><div>&copy; Garden Guides</div></body>""",
]

LAST = [
    """<body><div id="navi"><a href="/">Home</a><a href="/tips">Tips</a></div><div class="beitrag"><h1>{{Mending a wool jumper}}</h1><p>{{Pick up the loops around the hole with a thin needle before they run any further.}}</p>
    <p>{{Then weave yarn of the same weight across them, first along and then over and under.}}</p></div><div class="site-bottom">&copy; 2023 Thread and Needle</div></body>""",
    """<body><div class="brand-bar">Lake District Rowing</div><div id="main-col"><h1>{{Regatta moved to September}}</h1><p>{{Low water in the upper lake leaves the outer lanes too shallow for eights.}}</p>
    <p>{{The committee will meet again when the gauge reads more than two metres.}}</p></div><div id="right-rail"><h3>Related</h3><p><a href="/1">Crew list</a></p><p><a href="/2">Results of last year</a></p></div></body>""",
    """<body><a href="/">Index</a> <a href="/faq">FAQ</a><hr><h2>{{How to bleed a radiator}}</h2><ol><li>{{Switch off the pump and wait for ten minutes.}}</li><li>{{Hold a cup under the valve and turn the key slowly.}}</li><li>{{Close it as soon as water comes.}}</li></ol>
    <p>{{Afterwards check the pressure of the boiler, and fill it up if the needle is in the red.}}</p><hr>Webmaster: webmaster@example.com</body>""",
    """<body><header>Bird Notes</header><article><h1>{{First cuckoo heard}}</h1><p>{{It called twice from the alders by the weir, shortly before six.}}</p><p>{{Last year nobody had heard one before the second of May.}}</p></article>
    <div id="comments"><h2>2 comments</h2><div><p>Heard mine this morning as well!</p></div><div><p>None here yet.</p></div></div></body>""",
    """<body><div class="consent-box"><p>Cookies help us to run this page.</p><button>Fine</button></div><div class="t1"><h1>{{The last steam ferry}}</h1><p>{{She was built in 1911 and carried carts, cattle and later cars across the sound.}}</p><p>{{Her boiler was condemned in 1962, but a club has kept the hull afloat.}}</p></div><div class="t2"><a href="/">Home</a> | <a href="/j">Join</a></div></body>""",
    """<body><nav><a href="#">Menu</a></nav><div class="article__content"><p>{{A good knot holds under load and still comes apart when the rope is wet.}}</p><div class="advert">Ropes and chains, now cheaper</div><p>{{The bowline does both, which is why sailors learn it first.}}</p></div><footer><p>Terms</p></footer></body>""",
    """<body><div><div><h3>Hill Walker</h3></div><div><h1>{{Three days on the ridge}}</h1><p>{{We carried water for two days, because the springs under the summit run dry in August.}}</p><p>{{On the third morning the cloud lay below us like a white sea.}}</p></div><div><p>Share this page</p></div></div></body>""",
    """<body><div class="search"><label>Search</label><button>Go</button></div><main><h1>{{Harvest of salt}}</h1><p>{{The pans are flooded in spring, and by July the wind has left a crust as thick as a thumb.}}</p><figure><figcaption>{{Workers rake the salt into heaps.}}</figcaption></figure><p>{{It is washed in brine, never in fresh water.}}</p></main><aside><p>Visit our shop</p></aside></body>""",
    """<body><div id="header"><h1>The Parish Paper</h1></div><div id="content"><h2>{{Organ needs new bellows}}</h2><p>{{The leather has split in the cold of the last two winters, and the low pipes have lost their voice.}}</p><p>{{A concert in aid of the repair will be held on the first Sunday in Lent.}}</p></div><div id="footer">Printed on recycled paper</div></body>""",
    """<body><div class="post"><h1>{{Baking without an oven}}</h1><p>{{A heavy pot with a lid on a low flame does nearly as well as an oven.}}</p><p>{{Put a ring of foil under the tin, so that the bottom does not burn.}}</p></div><div class="post-comments"><p>Worked on my camping stove!</p></div><div class="tag-cloud"><a href="1">bread</a> <a href="2">camping</a></div></body>""",
]
