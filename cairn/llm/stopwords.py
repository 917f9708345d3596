"""Frequent function words of some languages, in the natural order of a word list.

A word that several languages share votes for each of them with a part of its vote.
"""

STOPWORDS = {
    "en": """the of and to in is are was were be been it its that this these those for with as on at by from or an a not no
        there their they them he she his her you your we our i me my have has had do does did will would can could should may
        what which who when where how why because so than then but if about into over after before under near some any more most
        other such only own same very just also while during between both each few all one two ago since until""",
    "tr": """ve bir bu şu o da de ki mi mı mu mü ne için ile gibi kadar çok daha en ama fakat ancak çünkü diye değil var yok
        olan olarak oldu olur olup ben sen biz siz onlar onu ona onun bunu buna bunun sana bana beni seni hangi kim kaç nasıl neden
        nerede nereye nedir ise her hiç hep yani göre sonra önce üzere hem veya ya içi içinde üzerinde altında altına altında yakınında
        yakınındaki çevresinde dahil toplam saat gün hafta ayında kısa süre şey bütün bazı kendi şimdi bile sadece zaten üzgünüm
        yoktur vardır kaçta hangisi ısıtılınca süre sularında tarafından yöresinde yöresine yöresinden""",
    "es": """el la los las un una unos unas de del y e o que en es son era fue ser está están estaba por para con sin sobre entre
        a al se su sus lo le les me te nos mi tu no ni sí más menos muy pero porque como cuando donde dónde cuándo cuánto cuántas cuántos
        qué quién cuál cómo este esta esto ese esa eso aquel ha han había hay ya también desde hasta antes después según cada todo toda
        todos otra otro poco ninguna ninguno nunca nadie cerca debajo durante tras""",
    "de": """der die das den dem des ein eine einen einem einer eines und oder aber denn weil dass ist sind war waren wird werden
        wurde wurden in im an am auf aus bei mit nach von vom zu zum zur für über unter vor durch gegen ohne um es er sie ihr ihn ihm
        ich du wir mich mir dich dir mein dein sein kein keine keiner nicht nichts nie wie was wer wo wann wohin warum welche welcher
        welchen welches auch nur noch schon so als wenn dann dort hier man hat habe haben hast wie viel viele dafür dazu damit
        insgesamt kurz etwas sehr mehr laut beim einmal seit bis""",
    "fr": """le la les un une des du de et ou mais que qui quoi dont où est sont était sera être ce cet cette ces il elle on nous
        vous ils elles je tu me te se lui leur son sa ses mon ma mes ton ta tes pas ne ni plus moins très dans en sur sous avec sans pour par
        chez entre vers avant après pendant quand comment combien pourquoi comme si aussi déjà encore à au aux près peu l'on qu'il
        d'un d'une c'est n'est y a été""",
    "it": """il lo la i gli le un uno una di del dello della dei degli delle e o ma che chi cui è sono era sarà essere questo questa
        questi quello quella si mi ti ci vi ne non né più meno molto in nel nella sul sulla con senza per da dal dalla tra fra a al alla
        quando dove come quanto perché se anche già ancora poco prima dopo vicino sotto sopra stato stata hai ha ho abbiamo hanno
        l'hai dell' all' tuo tua suo sua""",
    "pt": """o a os as um uma uns umas de do da dos das e ou mas que quem em no na nos nas é são era foi ser está estão por para
        pelo pela com sem sobre entre ao à se seu sua seus lhe me te nós você eles elas não nem sim mais menos muito quando onde como quanto
        porque este esta isto esse essa isso já também desde até antes depois segundo cada todo perto debaixo pouco foram havia""",
    "nl": """de het een en of maar dat die dit deze is zijn was waren wordt worden werd in op aan bij met van voor naar uit over onder
        door tegen zonder om te er hij zij ze het ik jij je wij we mij me hem haar mijn jouw geen niet niets nooit hoe wat wie waar wanneer
        waarom welke ook nog al zo als dan daar hier men heeft heb hebben hebt veel meer zeer kort dicht vlak tot sinds""",
    "pl": """i w z na do nie to jest są był była było się że co jak kiedy gdzie ile dlaczego który która które ten ta te tego tej
        dla od po przy pod nad przez bez ale lub oraz bo czy już jeszcze tylko bardzo mnie mi ty ja on ona my oni jego jej ich""",
    "sv": """och i att det som en ett är var på av för med till från den de om men inte jag du han hon vi ni dem sin så kan ska har
        hade när hur vad vem vilken där här under över efter innan nära mycket bara också eller""",
    "id": """yang dan di ke dari untuk dengan pada ini itu adalah tidak ada akan sudah oleh saya kamu dia kami mereka atau jika karena
        seperti bagaimana kapan dimana berapa apa siapa dalam lebih sangat juga""",
}

#: Scripts that by themselves tell a language from those written in Latin letters.
SCRIPTS = {
    "cyrillic": "Ѐ-ӿ", "greek": "Ͱ-Ͽ", "arabic": "؀-ۿ", "hebrew": "֐-׿",
    "han": "一-鿿", "kana": "぀-ヿ", "hangul": "가-힣", "devanagari": "ऀ-ॿ", "thai": "฀-๿",
    "armenian": "԰-֏", "georgian": "Ⴀ-ჿ",
}
