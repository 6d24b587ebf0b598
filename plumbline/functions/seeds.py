"""Everyday sentences in each language whose script others share: what the default language model is fitted on."""

SEEDS = {
    "en": """Hello there, good morning my friend. How are you today? I am very well, thank you, and you? My name is Anna and I live in a small house with my family.
        We don't know what they want, but it was the best thing that we could do. She said that he would come back with the children after school. This is not the way to write a
        letter, is it? Please tell me where the station is. There are many people who work in the city every day, and some of them have no time for breakfast. The weather is nice and the
        world has become smaller. I'm sorry, I can't help you with that because I have been here only for two weeks. Yes, of course you should visit the museum. Let us see which of these
        answers is right. Every sentence is short, almost every letter has been written, and there is no need for more. Have you ever thought about it? We had been looking for something
        new, but nothing happened until last night. When will you be able to make your own decision? It's great! Ok, see you tomorrow. Her mother bought bread, milk and cheese at the market.
        People always found other ways to go through life, even though these things often take a lot of time. Just think about how much we could have learned from each other.
        Who are you, where are you going now, and why? What do you think, which one is big, good or bad? He is, she has, we were, they will. Not always, never again, maybe later, really nothing else.""",
    "es": """Hola, buenos días amigo. ¿Cómo estás hoy? Estoy muy bien, gracias, ¿y tú? Me llamo Ana y vivo en una casa pequeña con mi familia. No sabemos qué quieren, pero fue lo mejor que
        pudimos hacer. Ella dijo que él volvería con los niños después de la escuela. Desayunamos en el hotel y luego fuimos a la playa. Por favor, dime dónde está la estación. Hay muchas
        personas que trabajan en la ciudad todos los días, y algunas no tienen tiempo para el desayuno. Hoy hace buen tiempo y el mundo se ha hecho más pequeño. Lo siento, no puedo ayudarte
        con eso porque sólo llevo aquí dos semanas. Sí, claro que debes visitar el museo. Vamos a ver cuál de estas respuestas es correcta. ¿Has pensado alguna vez en ello? Buscábamos algo
        nuevo, pero nada pasó hasta anoche. ¿Cuándo podrás tomar tu propia decisión? ¡Qué bueno! Hasta mañana, señor. Su madre compró pan, leche y queso en el mercado. Comemos, hablamos y
        trabajamos juntos cuando queremos. También hemos visto que nuestros hijos están muy contentos. Muchas gracias por todo, eres muy amable. Entonces el gato come pescado y el perro duerme.
        ¿Quién eres, adónde vas ahora y por qué? ¿Qué piensas, cuál es grande, bueno o malo? Él es, ella tiene, nosotros fuimos, ellos serán. No siempre, nunca más, quizás luego, nada, no entiendo.""",
    "pt": """Olá, bom dia meu amigo. Como você está hoje? Estou muito bem, obrigado, e você? Meu nome é Ana e moro numa casa pequena com a minha família. Não sabemos o que eles querem, mas
        foi o melhor que pudemos fazer. Ela disse que ele voltaria com as crianças depois da escola. Por favor, diga-me onde fica a estação. Há muitas pessoas que trabalham na cidade todos
        os dias, e algumas não têm tempo para o café da manhã. Hoje o tempo está bom e o mundo ficou menor. Desculpe, não posso ajudar com isso porque só estou aqui há duas semanas. Sim, é
        claro que você deve visitar o museu. Vamos ver qual destas respostas está certa. Você já pensou nisso? Procurávamos alguma coisa nova, mas nada aconteceu até ontem à noite. Quando
        poderá tomar a sua própria decisão? Muito bom! Até amanhã, senhor. A mãe dele comprou pão, leite e queijo no mercado. Também vimos que os nossos filhos estão muito felizes com as
        informações. Muito obrigada por tudo, boa noite. Então o gato come peixe e o cão dorme. Eles são irmãos e não têm razão. Eu gosto de ler livros em português.
        Quem é você, aonde vai agora e por quê? O que pensa, qual é grande, bom ou mau? Ele é, ela tem, a casa é nossa, eles serão. Nem sempre, nunca mais, talvez depois, nada, não entendo, ajuda.""",
    "fr": """Bonjour monsieur, comment allez-vous aujourd'hui ? Je vais très bien, merci, et vous ? Je m'appelle Anne et j'habite dans une petite maison avec ma famille. Nous ne savons pas ce
        qu'ils veulent, mais c'était la meilleure chose que nous pouvions faire. Elle a dit qu'il reviendrait avec les enfants après l'école. S'il vous plaît, dites-moi où est la gare. Il y a
        beaucoup de gens qui travaillent en ville tous les jours, et certains n'ont pas le temps pour le petit déjeuner. Il fait beau aujourd'hui et le monde est devenu plus petit. Je suis
        désolé, je ne peux pas vous aider parce que je ne suis ici que depuis deux semaines. Oui, bien sûr, vous devez visiter le musée. Voyons laquelle de ces réponses est juste. Avez-vous
        déjà pensé à cela ? Nous cherchions quelque chose de nouveau, mais rien ne s'est passé jusqu'à hier soir. Quand pourrez-vous prendre votre propre décision ? C'est très bon ! À demain,
        madame. Sa mère a acheté du pain, du lait et du fromage au marché. Bonsoir, salut mon ami, je t'aime beaucoup. Alors le chat mange du poisson et le chien dort. Être ou avoir, voilà la question.
        Qui es-tu, où vas-tu maintenant et pourquoi ? Que penses-tu, lequel est grand, bon ou mauvais ? Il est, elle a, nous sommes, ils seront. Pas toujours, jamais plus, peut-être après, rien, je ne comprends pas.""",
    "de": """Guten Morgen, mein Freund, wie geht es dir heute? Mir geht es sehr gut, danke, und dir? Ich heiße Anna und wohne in einem kleinen Haus mit meiner Familie. Wir wissen nicht, was
        sie wollen, aber es war das Beste, was wir tun konnten. Sie sagte, dass er nach der Schule mit den Kindern zurückkommen würde. Bitte sagen Sie mir, wo der Bahnhof ist. Es gibt viele
        Menschen, die jeden Tag in der Stadt arbeiten, und manche haben keine Zeit für das Frühstück. Heute ist das Wetter schön und die Welt ist kleiner geworden. Es tut mir leid, ich kann
        dir dabei nicht helfen, weil ich erst seit zwei Wochen hier bin. Ja, natürlich solltest du das Museum besuchen. Sehen wir, welche dieser Antworten richtig ist. Hast du schon einmal
        darüber nachgedacht? Wir suchten etwas Neues, aber bis gestern Abend ist nichts passiert. Wann kannst du deine eigene Entscheidung treffen? Sehr gut! Bis morgen, auf Wiedersehen. Seine
        Mutter kaufte Brot, Milch und Käse auf dem Markt. Guten Tag, gute Nacht, ich liebe dich. Dann frisst die Katze Fisch und der Hund schläft. Auch unsere Straße wurde zum Glück größer.
        Wer bist du, wohin gehst du jetzt und warum? Was denkst du, welches ist groß, gut oder schlecht? Er ist, sie hat, wir waren, sie werden. Nicht immer, nie wieder, vielleicht später, nichts, ich verstehe nicht.""",
    "it": """Ciao, buongiorno amico mio, come stai oggi? Sto molto bene, grazie, e tu? Mi chiamo Anna e abito in una piccola casa con la mia famiglia. Non sappiamo che cosa vogliono, ma era la
        cosa migliore che potessimo fare. Lei ha detto che lui sarebbe tornato con i bambini dopo la scuola. Per favore, dimmi dov'è la stazione. Ci sono molte persone che lavorano in città
        ogni giorno, e alcune non hanno tempo per la colazione. Oggi il tempo è bello e il mondo è diventato più piccolo. Mi dispiace, non posso aiutarti perché sono qui solo da due settimane.
        Sì, certo, dovresti visitare il museo. Vediamo quale di queste risposte è giusta. Ci hai mai pensato? Cercavamo qualcosa di nuovo, ma non è successo niente fino a ieri sera. Quando
        potrai prendere la tua decisione? Molto bene! A domani, signora. Sua madre ha comprato pane, latte e formaggio al mercato. Buona sera, buona notte, ti voglio bene. Allora il gatto mangia
        il pesce e il cane dorme. Anche gli studenti della nostra scuola hanno letto degli articoli nelle ultime settimane. Questo libro è mio, quello è tuo.
        Chi sei, dove vai adesso e perché? Che cosa pensi, quale è grande, buono o cattivo? Lui è, lei ha, noi siamo, loro saranno. Non sempre, mai più, forse dopo, niente, non capisco, mille grazie.""",
    "pl": """Dzień dobry, mój przyjacielu, jak się masz dzisiaj? Mam się bardzo dobrze, dziękuję, a ty? Nazywam się Anna i mieszkam w małym domu z moją rodziną. Nie wiemy, czego oni chcą, ale to
        była najlepsza rzecz, jaką mogliśmy zrobić. Powiedziała, że on wróci z dziećmi po szkole. Proszę mi powiedzieć, gdzie jest dworzec. Jest wielu ludzi, którzy codziennie pracują w mieście,
        a niektórzy nie mają czasu na śniadanie. Dzisiaj jest ładna pogoda, a świat stał się mniejszy. Przepraszam, nie mogę ci w tym pomóc, ponieważ jestem tu dopiero od dwóch tygodni. Tak,
        oczywiście, powinieneś odwiedzić muzeum. Zobaczmy, która z tych odpowiedzi jest poprawna. Czy kiedykolwiek o tym myślałeś? Szukaliśmy czegoś nowego, ale nic się nie stało do wczoraj
        wieczorem. Kiedy będziesz mógł podjąć własną decyzję? Bardzo dobrze! Do jutra, do widzenia. Jego matka kupiła chleb, mleko i ser na targu. Cześć, dobranoc, kocham cię. Kot je rybę, a
        pies śpi. Wszystko, co było przez te lata, jest już tylko wspomnieniem dla nas.
        Kim jesteś, dokąd teraz idziesz i dlaczego? Co myślisz, który jest duży, dobry albo zły? On jest, ona ma, my byliśmy, oni będą. Nie zawsze, nigdy więcej, może później, nic, nie rozumiem.""",
    "fi": """Hyvää huomenta, ystäväni, mitä kuuluu tänään? Minulle kuuluu oikein hyvää, kiitos, entä sinulle? Minun nimeni on Anna ja asun pienessä talossa perheeni kanssa. Emme tiedä, mitä he
        haluavat, mutta se oli parasta, mitä voimme tehdä. Hän sanoi, että hän tulisi takaisin lasten kanssa koulun jälkeen. Kertoisitko minulle, missä asema on? Kaupungissa työskentelee joka
        päivä paljon ihmisiä, ja joillakin ei ole aikaa aamiaiselle. Tänään on kaunis sää ja maailma on tullut pienemmäksi. Olen pahoillani, en voi auttaa sinua, koska olen ollut täällä vain
        kaksi viikkoa. Kyllä, tietenkin sinun pitäisi käydä museossa. Katsotaan, mikä näistä vastauksista on oikein. Oletko koskaan ajatellut sitä? Etsimme jotain uutta, mutta mitään ei tapahtunut
        eilisiltaan mennessä. Milloin voit tehdä oman päätöksesi? Erittäin hyvä! Nähdään huomenna, näkemiin. Hänen äitinsä osti leipää, maitoa ja juustoa torilta. Hei, hyvää yötä, minä rakastan
        sinua. Kissa syö kalaa ja koira nukkuu. Myös meidän lapsemme ovat olleet hyvin onnellisia.
        Kuka sinä olet, minne menet nyt ja miksi? Mitä ajattelet, kumpi on iso, hyvä tai huono? Hän on, hänellä on, me olimme, he tulevat. Ei aina, ei koskaan enää, ehkä myöhemmin, ei mitään, en ymmärrä.""",
    "sw": """Habari ya asubuhi, rafiki yangu, hujambo leo? Sijambo sana, asante, na wewe je? Jina langu ni Anna na ninaishi katika nyumba ndogo pamoja na familia yangu. Hatujui wanataka nini, lakini
        hilo lilikuwa jambo bora tuliloweza kufanya. Alisema kwamba atarudi pamoja na watoto baada ya shule. Tafadhali niambie kituo kiko wapi. Kuna watu wengi ambao wanafanya kazi mjini kila siku, na
        baadhi yao hawana wakati wa kifungua kinywa. Leo hali ya hewa ni nzuri na dunia imekuwa ndogo. Samahani, siwezi kukusaidia kwa sababu nimekuwa hapa kwa wiki mbili tu. Ndiyo, bila shaka
        unapaswa kutembelea makumbusho. Tuone ni jibu gani kati ya haya ni sahihi. Umewahi kufikiria jambo hilo? Tulikuwa tunatafuta kitu kipya, lakini hakuna kilichotokea mpaka jana usiku. Lini
        utaweza kufanya uamuzi wako mwenyewe? Vizuri sana! Tutaonana kesho, kwaheri. Mama yake alinunua mkate, maziwa na jibini sokoni. Karibu, lala salama, nakupenda. Paka anakula samaki na mbwa
        analala. Kiswahili ni lugha ya watu wa Afrika Mashariki.
        Wewe ni nani, unakwenda wapi sasa na kwa nini? Unafikiri nini, ipi ni kubwa, nzuri au mbaya? Yeye ni, ana, sisi tulikuwa, wao watakuwa. Si kila mara, kamwe tena, labda baadaye, hakuna kitu, sielewi.""",
    "vi": """Xin chào, chào buổi sáng bạn của tôi, hôm nay bạn có khỏe không? Tôi rất khỏe, cảm ơn, còn bạn? Tên tôi là Anna và tôi sống trong một ngôi nhà nhỏ với gia đình. Chúng tôi không biết họ muốn
        gì, nhưng đó là điều tốt nhất mà chúng tôi có thể làm. Cô ấy nói rằng anh ấy sẽ trở lại cùng các con sau giờ học. Làm ơn cho tôi biết nhà ga ở đâu. Có nhiều người làm việc ở thành phố mỗi
        ngày, và một số người không có thời gian ăn sáng. Hôm nay thời tiết đẹp và thế giới đã trở nên nhỏ hơn. Xin lỗi, tôi không thể giúp bạn vì tôi chỉ mới ở đây hai tuần. Vâng, tất nhiên bạn nên
        đến thăm bảo tàng. Hãy xem câu trả lời nào đúng. Bạn đã bao giờ nghĩ về điều đó chưa? Chúng tôi đang tìm một cái gì đó mới, nhưng không có gì xảy ra cho đến tối qua. Khi nào bạn có thể tự
        quyết định? Rất tốt! Hẹn gặp lại ngày mai, tạm biệt. Mẹ của anh ấy đã mua bánh mì, sữa và phô mai ở chợ. Con mèo ăn cá và con chó ngủ. Những điều này cũng được viết bằng tiếng Việt.
        Bạn là ai, bây giờ bạn đi đâu và tại sao? Bạn nghĩ gì, cái nào to, tốt hay xấu? Anh ấy là, cô ấy có, chúng tôi đã, họ sẽ. Không phải luôn luôn, không bao giờ nữa, có lẽ sau này, tôi không hiểu.""",
    "ru": """Привет, доброе утро, мой друг, как дела сегодня? У меня всё очень хорошо, спасибо, а у тебя? Меня зовут Анна, и я живу в маленьком доме со своей семьёй. Мы не знаем, чего они хотят, но это было
        лучшее, что мы могли сделать. Она сказала, что он вернётся с детьми после школы. Пожалуйста, скажите мне, где находится вокзал. Есть много людей, которые каждый день работают в городе, и у
        некоторых нет времени на завтрак. Сегодня хорошая погода, и мир стал меньше. Извините, я не могу вам помочь, потому что я здесь только две недели. Да, конечно, вы должны посетить музей.
        Посмотрим, какой из этих ответов правильный. Ты когда-нибудь думал об этом? Мы искали что-то новое, но ничего не произошло до вчерашнего вечера. Когда ты сможешь принять своё решение?
        Очень хорошо! До завтра, до свидания. Его мать купила хлеб, молоко и сыр на рынке. Спокойной ночи, я тебя люблю. Кошка ест рыбу, а собака спит. Это был один из тех дней, когда мы были вместе.
        Ещё раз большое спасибо, вы очень добры. Нельзя сказать, что эти вопросы были лёгкими для нас.
        Кто ты, куда ты идёшь сейчас и почему? Что ты думаешь, какой большой, хороший или плохой? Он есть, у неё есть, мы были, они будут. Не всегда, никогда больше, может быть позже, ничего, я не понимаю.""",
    "uk": """Привіт, доброго ранку, мій друже, як справи сьогодні? У мене все дуже добре, дякую, а в тебе? Мене звати Анна, і я живу в маленькому будинку зі своєю сім'єю. Ми не знаємо, чого вони хочуть, але це
        було найкраще, що ми могли зробити. Вона сказала, що він повернеться з дітьми після школи. Будь ласка, скажіть мені, де знаходиться вокзал. Є багато людей, які щодня працюють у місті, і деякі
        не мають часу на сніданок. Сьогодні гарна погода, і світ став меншим. Вибачте, я не можу вам допомогти, тому що я тут лише два тижні. Так, звичайно, ви повинні відвідати музей. Подивимося, яка
        з цих відповідей правильна. Ти коли-небудь думав про це? Ми шукали щось нове, але нічого не сталося до вчорашнього вечора. Коли ти зможеш прийняти своє рішення? Дуже добре! До завтра, до
        побачення. Його мати купила хліб, молоко і сир на ринку. На добраніч, я тебе кохаю. Кішка їсть рибу, а собака спить. Їхні діти також були щасливі, що приїхали до України.
        Хто ти, куди ти йдеш зараз і чому? Що ти думаєш, який великий, добрий чи поганий? Він є, у неї є, ми були, вони будуть. Не завжди, ніколи більше, може пізніше, нічого, я не розумію.""",
    "bg": """Здравей, добро утро, приятелю, как си днес? Аз съм много добре, благодаря, а ти? Казвам се Анна и живея в малка къща със семейството си. Ние не знаем какво искат те, но това беше най-доброто,
        което можехме да направим. Тя каза, че той ще се върне с децата след училище. Моля, кажете ми къде е гарата. Има много хора, които работят в града всеки ден, и някои нямат време за закуска. Днес
        времето е хубаво и светът стана по-малък. Съжалявам, не мога да ви помогна, защото съм тук само от две седмици. Да, разбира се, трябва да посетите музея. Да видим кой от тези отговори е верен.
        Мислил ли си някога за това? Търсехме нещо ново, но нищо не се случи до снощи. Кога ще можеш да вземеш собствено решение? Много добре! До утре, довиждане. Майка му купи хляб, мляко и сирене на
        пазара. Лека нощ, обичам те. Котката яде риба, а кучето спи. Всички тези въпроси бяха лесни за нас, но отговорите им не са били написани.
        Кой си ти, къде отиваш сега и защо? Какво мислиш, кой е голям, добър или лош? Той е, тя има, ние бяхме, те ще бъдат. Не винаги, никога вече, може би по-късно, нищо, не разбирам.""",
    "ar": """مرحبا، صباح الخير يا صديقي، كيف حالك اليوم؟ أنا بخير جدا، شكرا، وأنت؟ اسمي آنا وأعيش في بيت صغير مع عائلتي. نحن لا نعرف ماذا يريدون، لكن ذلك كان أفضل شيء يمكننا فعله. قالت إنه سيعود مع الأطفال بعد
        المدرسة. من فضلك قل لي أين المحطة. هناك كثير من الناس الذين يعملون في المدينة كل يوم، وبعضهم ليس لديه وقت للفطور. الطقس جميل اليوم وقد أصبح العالم أصغر. آسف، لا أستطيع مساعدتك لأنني هنا منذ أسبوعين
        فقط. نعم، بالطبع يجب أن تزور المتحف. لنر أي من هذه الإجابات صحيحة. هل فكرت في ذلك من قبل؟ كنا نبحث عن شيء جديد، ولكن لم يحدث شيء حتى الليلة الماضية. متى تستطيع أن تتخذ قرارك؟ جيد جدا! إلى اللقاء غدا. اشترت
        والدته الخبز والحليب والجبن من السوق. تصبح على خير. القطة تأكل السمك والكلب ينام. هذه هي اللغة العربية التي يتحدث بها الناس في كثير من البلدان.""",
    "fa": """سلام، صبح بخیر دوست من، امروز حالت چطور است؟ من خیلی خوبم، ممنون، تو چطوری؟ نام من آنا است و با خانواده‌ام در یک خانه کوچک زندگی می‌کنم. ما نمی‌دانیم آنها چه می‌خواهند، اما این بهترین کاری بود که می‌توانستیم
        انجام دهیم. او گفت که بعد از مدرسه با بچه‌ها برمی‌گردد. لطفا به من بگویید ایستگاه کجاست. افراد زیادی هستند که هر روز در شهر کار می‌کنند و بعضی از آنها برای صبحانه وقت ندارند. امروز هوا خوب است و دنیا کوچکتر شده است.
        متاسفم، نمی‌توانم به شما کمک کنم چون فقط دو هفته است که اینجا هستم. بله، البته باید از موزه دیدن کنید. ببینیم کدام یک از این پاسخ‌ها درست است. آیا تا به حال به آن فکر کرده‌ای؟ ما دنبال چیز تازه‌ای بودیم، ولی تا دیشب هیچ
        اتفاقی نیفتاد. کی می‌توانی تصمیم خودت را بگیری؟ خیلی خوب! تا فردا، خداحافظ. مادرش از بازار نان و شیر و پنیر خرید. شب بخیر، دوستت دارم. گربه ماهی می‌خورد و سگ می‌خوابد. زبان فارسی را بسیاری از مردم ایران می‌دانند.""",
    "ur": """السلام علیکم، صبح بخیر میرے دوست، آج آپ کیسے ہیں؟ میں بہت اچھا ہوں، شکریہ، اور آپ؟ میرا نام آنا ہے اور میں اپنے خاندان کے ساتھ ایک چھوٹے گھر میں رہتی ہوں۔ ہم نہیں جانتے کہ وہ کیا چاہتے ہیں، لیکن یہ سب سے اچھی چیز تھی جو
        ہم کر سکتے تھے۔ اس نے کہا کہ وہ اسکول کے بعد بچوں کے ساتھ واپس آئے گا۔ براہ کرم مجھے بتائیں کہ اسٹیشن کہاں ہے۔ بہت سے لوگ ہیں جو ہر روز شہر میں کام کرتے ہیں، اور کچھ کے پاس ناشتے کے لیے وقت نہیں ہوتا۔ آج موسم اچھا ہے اور دنیا
        چھوٹی ہو گئی ہے۔ معاف کیجیے، میں آپ کی مدد نہیں کر سکتا کیونکہ میں یہاں صرف دو ہفتوں سے ہوں۔ جی ہاں، آپ کو عجائب گھر ضرور دیکھنا چاہیے۔ دیکھتے ہیں ان میں سے کون سا جواب درست ہے۔ کیا آپ نے کبھی اس کے بارے میں سوچا؟ ہم کچھ نیا
        ڈھونڈ رہے تھے، لیکن کل رات تک کچھ نہیں ہوا۔ بہت اچھا! کل ملیں گے، خدا حافظ۔ اس کی ماں نے بازار سے روٹی، دودھ اور پنیر خریدا۔ بلی مچھلی کھاتی ہے اور کتا سوتا ہے۔ یہ اردو زبان ہے۔""",
    "hi": """नमस्ते, सुप्रभात मेरे दोस्त, आज आप कैसे हैं? मैं बहुत अच्छा हूँ, धन्यवाद, और आप? मेरा नाम आना है और मैं अपने परिवार के साथ एक छोटे घर में रहती हूँ। हम नहीं जानते कि वे क्या चाहते हैं, लेकिन यह सबसे अच्छी बात थी जो हम कर
        सकते थे। उसने कहा कि वह स्कूल के बाद बच्चों के साथ वापस आएगा। कृपया मुझे बताइए कि स्टेशन कहाँ है। बहुत से लोग हैं जो हर दिन शहर में काम करते हैं, और कुछ के पास नाश्ते के लिए समय नहीं होता। आज मौसम अच्छा है और दुनिया छोटी हो
        गई है। माफ कीजिए, मैं आपकी मदद नहीं कर सकता क्योंकि मैं यहाँ केवल दो हफ्ते से हूँ। हाँ, आपको संग्रहालय जरूर देखना चाहिए। देखते हैं इनमें से कौन सा उत्तर सही है। क्या आपने कभी इसके बारे में सोचा? हम कुछ नया ढूँढ रहे थे, लेकिन
        कल रात तक कुछ नहीं हुआ। बहुत अच्छा! कल मिलेंगे, अलविदा। उसकी माँ ने बाजार से रोटी, दूध और पनीर खरीदा। बिल्ली मछली खाती है और कुत्ता सोता है। यह हिन्दी भाषा है।""",
    "mr": """नमस्कार, शुभ सकाळ माझ्या मित्रा, आज तू कसा आहेस? मी खूप छान आहे, धन्यवाद, आणि तू? माझे नाव आना आहे आणि मी माझ्या कुटुंबासोबत एका लहान घरात राहते. त्यांना काय हवे आहे हे आम्हाला माहीत नाही, पण आम्ही करू शकलो ती सर्वात
        चांगली गोष्ट होती. ती म्हणाली की तो शाळेनंतर मुलांसोबत परत येईल. कृपया मला सांगा स्टेशन कुठे आहे. शहरात दररोज काम करणारे अनेक लोक आहेत, आणि काहींना नाश्त्यासाठी वेळ नसतो. आज हवामान चांगले आहे आणि जग लहान झाले आहे. माफ करा,
        मी तुम्हाला मदत करू शकत नाही कारण मी येथे फक्त दोन आठवड्यांपासून आहे. होय, नक्कीच तुम्ही संग्रहालयाला भेट दिली पाहिजे. यापैकी कोणते उत्तर बरोबर आहे ते पाहूया. तुम्ही कधी याबद्दल विचार केला आहे का? आम्ही काहीतरी नवीन शोधत होतो, पण काल
        रात्रीपर्यंत काहीच घडले नाही. खूप छान! उद्या भेटू. त्याच्या आईने बाजारातून भाकरी, दूध आणि चीज विकत घेतले. मांजर मासे खाते आणि कुत्रा झोपतो. ही मराठी भाषा आहे.""",
    "ne": """नमस्ते, शुभ प्रभात मेरो साथी, आज तिमीलाई कस्तो छ? मलाई धेरै राम्रो छ, धन्यवाद, अनि तिमीलाई? मेरो नाम आना हो र म मेरो परिवारसँग एउटा सानो घरमा बस्छु। उनीहरू के चाहन्छन् हामीलाई थाहा छैन, तर त्यो हामीले गर्न सक्ने सबैभन्दा राम्रो
        कुरा थियो। उनले भनिन् कि ऊ विद्यालयपछि बच्चाहरूसँग फर्कनेछ। कृपया मलाई स्टेशन कहाँ छ भन्नुहोस्। धेरै मानिसहरू छन् जो हरेक दिन सहरमा काम गर्छन्, र कसैसँग खाजाको लागि समय हुँदैन। आज मौसम राम्रो छ र संसार सानो भएको छ। माफ गर्नुहोस्,
        म तपाईंलाई मद्दत गर्न सक्दिनँ किनभने म यहाँ दुई हप्ता मात्र भएको छु। हो, तपाईंले सङ्ग्रहालय अवश्य हेर्नुपर्छ। यी मध्ये कुन उत्तर सही छ हेरौं। के तपाईंले कहिल्यै यसबारे सोच्नुभएको छ? हामी केही नयाँ खोजिरहेका थियौं, तर हिजो राति सम्म केही भएन।
        धेरै राम्रो! भोलि भेटौंला। उसको आमाले बजारबाट रोटी, दूध र पनिर किन्नुभयो। बिरालोले माछा खान्छ र कुकुर सुत्छ। यो नेपाली भाषा हो।""",
}
